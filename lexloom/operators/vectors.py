"""Vector retrieval: validation, dense cosine and sparse IDF-weighted top-k for sets of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.sources.tables import new_folder, spread, stored


def dense_ok(vector: Column) -> Column:
    """Not empty, and every value finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def parse_sparse(weights: Column) -> tuple[Column, Column]:
    """(indices, values) of a map of term index to weight: zeros dropped, by index."""
    pairs = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] != 0))
    return F.transform(pairs, lambda e: e["key"]), F.transform(pairs, lambda e: e["value"])


def sparse_ok(weights: Column) -> Column:
    """Indices from 0 up, values finite."""
    return F.coalesce(F.forall(F.map_entries(weights), lambda e: (e["key"] >= 0) & e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf"))), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def ranked(scored: DataFrame, limit: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The best `limit` rows of each query with their rank; equal scores by id. The engine prunes groups before the shuffle."""
    if limit <= 0:
        return scored.where(F.lit(False)).withColumn("rank", F.lit(0).cast("long"))
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


#: Bytes of query vectors or weights that go to every task at most; more queries are worked off in several passes.
PASS_BYTES = 64 << 20
#: Digits of a score: matrix products of other shapes differ in the last bits, which must not decide ties.
DIGITS = 12
#: Queries that are multiplied at once.
QUERY_BLOCK = 500
#: Points that are multiplied with them at once.
_DENSE_POINTS = 1_000


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


class _Best:
    """The best `limit` of each query among what a task has seen: score first, then id."""

    def __init__(self, limit: int) -> None:
        # floor: a score that `limit` points of a query reach already; what is below it is let go at once
        self.limit, self.parts, self.held, self.floor = limit, [], 0, np.empty(0)

    def add(self, first: int, ids: pd.Series, scores: np.ndarray, there: np.ndarray | None = None) -> None:
        """scores[i, j] of the points `ids` for the queries from number `first` on; `there` marks those that count."""
        if not scores.size:
            return
        if len(self.floor) < (end := first + scores.shape[1]):
            self.floor = np.concatenate([self.floor, np.full(end - len(self.floor), -np.inf)])
        shown, floor = scores if there is None else np.where(there, scores, -np.inf), self.floor[first:end]
        good = (shown >= floor) & (shown > -np.inf)
        if len(many := np.flatnonzero(good.sum(axis=0) > self.limit)):
            part = shown[:, many]
            floor[many] = least = np.partition(part, len(ids) - self.limit, axis=0)[len(ids) - self.limit]
            good[:, many] &= part >= least
        point, query = np.nonzero(good)
        self.parts.append(pd.DataFrame({"q": query + first, "id": ids.to_numpy()[point], "score": scores[point, query]}))
        self.held += len(point)
        if self.held > max(200_000, 4 * self.limit * len(self.floor)):
            rows = self.rows()
            self.parts, self.held = [rows], len(rows)
            last = rows[rows.groupby("q").cumcount() == self.limit - 1]
            self.floor[last["q"].to_numpy()] = last["score"].to_numpy()

    def rows(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        rows = pd.concat(self.parts).sort_values(["q", "score", "id"], ascending=[True, False, True])
        return rows[rows.groupby("q").cumcount() < self.limit]


def _by_pass(queries: DataFrame, weight: Column, score: Callable[[pa.Table], tuple[DataFrame, Broadcast]], kinds: str, limit: int) -> DataFrame:
    """score(table of queries) gives the scored points and the broadcast they rest on; here for all queries, ranked.

    Queries whose weights come to more than PASS_BYTES are dealt into passes, one after the other: each is gathered, sent
    out, its best points written, and let go before the next, so the driver and the tasks hold one pass whatever their number.
    """
    spark = queries.sparkSession
    total = (queries.agg(F.sum(weight)).first()[0] or 0) if limit > 0 else 0
    parts = -(-int(total) // PASS_BYTES)
    if parts == 0:
        return ranked(spark.createDataFrame([], kinds), limit)
    if parts == 1:
        return ranked(score(queries.toArrow())[0], limit)
    queries, folder = stored(queries, "queries"), new_folder(spark, "hits")
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow()
        if rows.num_rows:
            scored, shared = score(rows)
            ranked(scored, limit).write.parquet(f"{folder}/pass={p}")
            shared.destroy()
        del rows
    return spark.read.schema(f"{kinds}, rank long").parquet(f"{folder}/*")


def dense_top_k(points: DataFrame, queries: DataFrame, limit: int = 20, digits: int | None = DIGITS) -> DataFrame:
    """(query_id, id, score, rank) by cosine. points (id, dense), queries (query_id, dense).

    A stated set of queries against all points: queries go to the tasks as matrices of bounded size, each task multiplies
    its points with them and keeps the best of each query, and only those are shuffled. Vectors that are empty or not
    finite are left out; of a zero vector every cosine is 0.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    good = points.where(dense_ok(F.col("dense"))).select("id", "dense")
    own = queries.where(dense_ok(F.col("dense"))).select("query_id", "dense")

    def matrix(rows: list) -> np.ndarray:
        x = np.array(rows, np.float64)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    digits = DIGITS if digits is None else digits

    def scored(got: pa.Table) -> tuple[DataFrame, Broadcast]:
        shared = points.sparkSession.sparkContext.broadcast((got.column(0).to_pylist(), matrix(got.column(1).to_pylist())))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (names, asked), best = shared.value, _Best(limit)
            for batch in batches:
                for p in range(0, len(batch), _DENSE_POINTS):
                    part = batch.iloc[p : p + _DENSE_POINTS]
                    x = matrix(part["dense"].tolist())
                    for a in range(0, len(names), QUERY_BLOCK):
                        best.add(a, part["id"], _rounded(x @ asked[a : a + QUERY_BLOCK].T, digits))
            rows = best.rows()
            yield pd.DataFrame({"query_id": [names[int(q)] for q in rows["q"]], "id": rows["id"], "score": rows["score"]})

        return good.mapInPandas(score, kinds), shared

    return _by_pass(own, F.lit(8) * F.size("dense"), scored, kinds, limit)


def term_vectors(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, terms, tfs): the lower-cased ASCII words of each text and how often it has them; in place, without a shuffle."""
    kind = f"id {texts.schema[id_col].dataType.simpleString()}, terms array<string>, tfs array<double>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = _plain(batch.column(1))
            for a in range(0, len(batch), _TEXTS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, _TEXTS), *_counted(plain.slice(a, _TEXTS))], names=["id", "terms", "tfs"])

    return texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).mapInArrow(count, kind)


#: Texts whose words are counted at once.
_TEXTS = 500
#: Each byte that is not a letter from a to z as a space; so are all bytes of other characters.
_LETTERS = np.where((np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z")), np.arange(256), ord(" ")).astype(np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    data = data if data is None else pa.py_buffer(_LETTERS[np.frombuffer(data, np.uint8)])
    return pa.LargeStringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset)


def _counted(plain: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(words, how often) of each text."""
    split = pc.ascii_split_whitespace(plain)
    found = pc.dictionary_encode(split.flatten())
    words = found.dictionary
    word = found.indices.to_numpy()
    key = np.repeat(np.arange(len(plain)), pc.list_value_length(split).to_numpy()) * len(words) + word
    key, times = np.unique(key[pc.not_equal(words, "").to_numpy(zero_copy_only=False)[word]], return_counts=True)
    text, word = np.divmod(key, max(1, len(words)))
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(plain))))), pa.int32())
    return pa.ListArray.from_arrays(ends, words.take(pa.array(word)).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(times.astype(float)))


def idf(n: Column, docs: Column) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)) (Robertson and Zaragoza 2009), a choice of ours: the store does not say its form."""
    return F.log(1 + (docs - n + 0.5) / (n + 0.5))


#: Points that are scored first, those of the largest weights: what they reach lets most of the others be left out unscored.
FIRST_POINTS = 2_000
#: Bytes of a query's weight in the broadcast.
_WEIGHT_BYTES = 24
#: Points that are scored at once, fewer where they would have more scores than _SCORES.
_POINT_BLOCK = 250
_SCORES = 4_000_000
#: Terms of the queries that are numbered for all passes at once; of more, each pass numbers its own.
KNOWN_TERMS = 4_000_000


def sparse_top_k(vectors: DataFrame, queries: DataFrame, n_docs: int, limit: int = 20, digits: int | None = DIGITS) -> DataFrame:
    """(query_id, id, score, rank) by the sum of query weight, point weight and IDF over common terms; both sides (id or query_id, terms, tfs).

    The queries' weights go to the tasks, at most PASS_BYTES at a time, and each task scores its points in place: no term
    gathers the points that have it. Terms that many of the queries have are a matrix, the others lists. The points of the
    largest weights come first. A score is at most the product of both norms (Cauchy and Schwarz), so a point whose bound is
    below the last score that a query has already is not among its best and is not scored for it.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    spark = vectors.sparkSession
    asked = queries.select("query_id", "terms", "tfs")
    # counted before the queries' terms are picked: of a term, one row leaves a task
    terms_of = lambda df: df.select(F.explode("terms").alias("term"))
    counted = terms_of(vectors).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms_of(asked).distinct(), "term", "left_semi")
    seen = stored(counted.select("term", idf(F.col("n"), F.lit(n_docs)).alias("idf")), "seen")
    digits = DIGITS if digits is None else digits
    shape = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("id", to_arrow_type(vectors.schema["id"].dataType)), ("score", pa.float64())])
    n_first = FIRST_POINTS if limit > 0 and n_docs > 4 * FIRST_POINTS else 0

    def known(rows: DataFrame) -> tuple[pa.Table, DataFrame, DataFrame | None]:
        """(term, idf) by number, the vectors by number, and those of them that come first."""
        table = rows.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(table.column("term").combine_chunks())
        points = spread(stored(_numbered(vectors, shared), "numbered"))
        shared.destroy()
        return table, points, _largest(points, n_first) if n_first else None

    for_all = known(seen) if limit > 0 and seen.count() <= KNOWN_TERMS else None

    def scored(got: pa.Table) -> tuple[DataFrame, Broadcast]:
        context, names = spark.sparkContext, got.column("query_id").to_pylist()
        own = for_all or known(seen.join(terms_of(spark.createDataFrame(got.select(["terms"]))).distinct(), "term", "left_semi"))
        points, first, terms = own[1], own[2], _Terms(got, own[0])
        reach = np.full(len(names), -np.inf)
        if first is not None:
            shared = context.broadcast((names, terms, None))
            last = ranked(score(first, shared), limit).where(F.col("rank") == limit).select("query_id", "score").toArrow()
            shared.destroy()
            place = {q: i for i, q in enumerate(names)}
            # half a unit of the last digit, and what sums in another order may differ by
            low = last.column(1).to_numpy() - 10.0**-digits
            reach[[place[q] for q in last.column(0).to_pylist()]] = low - 1e-9 * np.abs(low)
            reach = np.where(reach > 0, np.divide(reach, terms.norms, out=np.full(len(names), np.inf), where=terms.norms > 0), np.where(terms.empty, np.inf, -np.inf))
            order = np.argsort(reach, kind="stable")
            names, terms, reach = [names[i] for i in order], terms.ordered(order), reach[order]
        shared = context.broadcast((names, terms, reach))
        return score(points, shared), shared

    def score(points: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (names, terms, reach), best = shared.value, _Best(limit)
            common, plain = terms.common, terms.plain
            block = min(_POINT_BLOCK, 1 + _SCORES // max(1, len(names)))
            for batch in batches:
                at, place, tf = _placed(batch.column(1), batch.column(2), terms.places)
                norms = np.sqrt(np.bincount(at, (tf * terms.scale[place]) ** 2, len(batch)))
                # from the largest norm down, each block with the queries that its first point may reach
                order = np.argsort(-norms, kind="stable")
                new = np.argsort(order, kind="stable")[at]
                spots = np.argsort(new, kind="stable")
                at, place, tf = new[spots], place[spots], tf[spots]
                ids, norms = batch.column(0).to_pandas().iloc[order], norms[order]
                # queries that each point may reach, up to the next step
                within = np.full(len(batch), len(names)) if reach is None else terms.up(np.searchsorted(reach, norms, "right"))
                for a in range(0, len(batch), block):
                    n = int(within[a])
                    if not n:
                        break
                    b = min(a + block, len(batch))
                    i, j = np.searchsorted(at, [a, b])
                    row, own, value = at[i:j] - a, place[i:j], tf[i:j]
                    total, there = np.zeros((b - a, n)), None if plain else np.zeros((b - a, n), bool)
                    rare = own >= len(common)
                    listed = own[rare] - len(common)
                    # without negative weights, what a point lacks for queries out of its own reach leaves it below what they have
                    ends = terms.ends(within[a:b][row[rare]] if plain else n, listed)
                    for spot, product in _spread(row[rare], listed, value[rare], terms.starts, terms.of, terms.weight, n, ends):
                        np.add.at(total.reshape(-1), spot, product)
                        if not plain:
                            there.reshape(-1)[spot] = True
                    held = np.zeros((b - a, len(common)))
                    held[row[~rare], own[~rare]] = value[~rare]
                    total += held @ common[:, :n]
                    # where no weight is negative a common term shows in the sum
                    there = total > 0 if plain else there | (held @ (common[:, :n] != 0) > 0)
                    best.add(0, ids.iloc[a:b], _rounded(total, digits), there)
            rows = best.rows()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": [names[int(q)] for q in rows["q"]], "id": rows["id"], "score": rows["score"]}), schema=shape, preserve_index=False)

        return points.mapInArrow(run, kinds)

    return _by_pass(asked, F.lit(_WEIGHT_BYTES) * F.size("terms") + 1, scored, kinds, limit)


def _largest(vectors: DataFrame, n: int) -> DataFrame:
    """The n vectors of the largest norms, those of equal norms by the hash of their ids."""
    size = F.struct(F.aggregate("tfs", F.lit(0.0), lambda s, x: s + x * x).alias("a"), F.xxhash64("id").alias("b"))
    least = vectors.select(size.alias("s")).orderBy(F.desc("s")).limit(n).agg(F.min("s").alias("s")).first()["s"]
    return stored(vectors.where(size >= F.struct(F.lit(least["a"]).alias("a"), F.lit(least["b"]).alias("b"))), "first")


def _codes(terms: pa.Array, known: pa.Array) -> np.ndarray:
    """The number of each term of the lists, -1 of one that is not known; each different term is looked up once."""
    found = pc.dictionary_encode(terms.flatten())
    number = np.append(pc.fill_null(pc.index_in(found.dictionary, value_set=known), -1).to_numpy(), np.int32(-1))
    return number[pc.fill_null(found.indices, len(number) - 1).to_numpy()]


def _numbered(vectors: DataFrame, known: Broadcast) -> DataFrame:
    """(id, terms, tfs) with the numbers of the terms that are known in place of the terms; the others add to no score."""
    kind = f"id {vectors.schema['id'].dataType.simpleString()}, terms array<int>, tfs array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            number = _codes(batch.column(1), known.value)
            own = number >= 0
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[own], minlength=len(sizes))))), pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(number[own], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(batch.column(2).flatten().to_numpy()[own], pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "terms", "tfs"])

    return vectors.select("id", "terms", F.col("tfs").cast("array<double>")).mapInArrow(run, kind)


def _placed(numbers: pa.Array, tfs: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tf) of the numbered terms that a query of the pass has."""
    place = places[numbers.flatten().to_numpy()]
    own = place >= 0
    return np.repeat(np.arange(len(numbers)), pc.list_value_length(numbers).to_numpy())[own], place[own], tfs.flatten().to_numpy()[own]


#: Products of point and query weights that are held at once.
_PRODUCTS = 200_000
#: Numbers of first queries, each 0.85 of the one before, for which the ends of the lists are kept.
_STEPS = 24


class _Terms:
    """The terms of a pass of queries (query_id, terms, tfs): those of over a sixteenth of the queries a matrix, then lists of (query, weight) of the others."""

    def __init__(self, got: pa.Table, known: pa.Table) -> None:
        term, tf, known_idf = got.column("terms").combine_chunks(), got.column("tfs").combine_chunks(), known.column("idf").to_numpy()
        self.n = len(got)
        number = _codes(term, known.column("term").combine_chunks())
        own = number >= 0
        query = np.repeat(np.arange(self.n, dtype=np.int32), pc.fill_null(pc.list_value_length(term), 0).to_numpy())[own]
        self.empty = np.bincount(query, minlength=self.n) == 0
        number, tf = number[own], tf.flatten().to_numpy()[own]
        times = np.bincount(number, minlength=len(known))
        used = np.flatnonzero(times)
        times = times[used]
        n_common = int((times * 16 > self.n).sum())
        self.places = np.full(len(known), -1, np.int32)
        self.places[used] = np.argsort(np.argsort(times * 16 <= self.n, kind="stable"), kind="stable")
        place, scale = self.places[number], np.zeros(len(used))
        scale[self.places[used]] = np.sqrt(np.abs(known_idf[used]))
        w = tf * known_idf[number]
        self.scale, self.plain = scale, not (w < 0).any()
        self.norms = np.sqrt(np.bincount(query, np.divide(w, scale[place], out=np.zeros_like(w), where=w != 0) ** 2, self.n))
        self.common = np.zeros((n_common, self.n))
        often = place < n_common
        self.common[place[often], query[often]] = w[often]
        self._lists(place[~often] - n_common, query[~often], w[~often], len(used) - n_common)

    def _lists(self, place: np.ndarray, query: np.ndarray, w: np.ndarray, n_terms: int) -> None:
        key = place.astype(np.int64) * self.n + query
        order = np.argsort(key, kind="stable")
        self.key, self.of, self.weight = key[order], query[order].astype(np.int32), w[order]
        self.starts = np.searchsorted(self.key, np.arange(n_terms + 1) * self.n)
        self.steps, self.stops = np.array([self.n]), self.starts[None, 1:]

    def ordered(self, order: np.ndarray) -> _Terms:
        """The same with the queries in another order, and the ends of the lists for their first ones, in steps."""
        out = copy(self)
        out.common, out.norms = np.ascontiguousarray(self.common[:, order]), self.norms[order]
        out._lists(self.key // self.n, np.argsort(order, kind="stable")[self.of], self.weight, len(self.starts) - 1)
        out.steps = np.unique(np.maximum(1, self.n * 0.85 ** np.arange(_STEPS)).astype(np.int64))
        out.stops = np.stack([np.searchsorted(out.key, np.arange(len(out.starts) - 1) * self.n + step) for step in out.steps]).astype(np.int32)
        return out

    def up(self, n: np.ndarray) -> np.ndarray:
        """Numbers of first queries, taken up to the next step; none stays none."""
        return np.where(n > 0, self.steps[np.searchsorted(self.steps, n)], 0)

    def ends(self, n: np.ndarray | int, place: np.ndarray) -> np.ndarray:
        """Where the lists at these places end for the first n queries, n being a step or none."""
        return np.where(np.asarray(n) > 0, self.stops[np.searchsorted(self.steps, n), place], self.starts[place])


def _spread(at: np.ndarray, place: np.ndarray, tf: np.ndarray, starts: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row * n + query, product) of listed terms with the queries that have them, in order of the terms; a term's list ends at the next, or before it at its `ends`."""
    sizes = (starts[place + 1] if ends is None else ends) - starts[place]
    last = np.cumsum(sizes)
    inner = np.searchsorted(last, np.arange(_PRODUCTS, last[-1], _PRODUCTS)) if len(last) else []
    cuts = np.unique([0, *inner, len(last)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = sizes[a:b]
        own = np.arange(size.sum()) + np.repeat(starts[place[a:b]] - np.cumsum(size) + size, size)
        yield np.repeat(at[a:b] * n, size) + of[own], np.repeat(tf[a:b], size) * weight[own]
