"""Personal data: base patterns, high-recall candidates judged by boosted trees, and redaction. DataFrame functions only.

Base spans are the valid matches of one pattern per kind, leftmost and not overlapping. All loops of the patterns are
possessive and start where a run starts (or where the last match ended), so that long runs cost linear time and no
stack. Next to them generators propose looser, overlapping spans of each kind: card numbers in 13 to 19 digits, phone
numbers with or without a plus, dotted quads, spelled-out e-mail addresses. Boosted regression trees score each proposal
from its format and the words around it; the trees become one SQL expression. A threshold for each kind, calibrated on
held-out examples, selects spans; none that overlaps a base span stays, and of several kinds the stricter format does.

The trees are trained here on examples that `_examples` makes from templates (EXAMPLES rows, fixed seed): personal data in
personal contexts against look-alikes (versions, order numbers, hashes, sums). They never see the corpus.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import named, unused, whole

KINDS = ("email", "ip", "card", "phone")

# the base patterns; greedy loops without a second way are written possessive, which matches the same; runs of fewer than 12
# digits, which fail as cards, are not gathered
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11}(?:[\x20-]?+[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to match; a cheap test first.
NEEDS = {"email": "@", "ip": ".", "card": "[0-9](?:[ -]?[0-9]){11}", "phone": "+"}

GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,63}+){1,4}| at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{2,63}+){1,4})",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}(?!\.?[0-9])|(?:[0-9A-Fa-f]{1,4}+:){5,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}+:){1,6}+:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,4}+(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
GENERATOR_NEEDS = {"email": r"[(\[]at[)\]]| dot ", "ip": r"[0-9]\[?\.\]?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": "[0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{3}"}

CONTEXT = 32
GOOD_WORDS = {"email": "mail|contact|write|reach|address", "ip": "ip|address|host|client|login|from|connect", "card": "card|visa|pay|credit|account|charge|billing", "phone": "phone|call|tel|fax|mobile|contact|dial|reach"}
BAD_WORDS = "version|release|section|order|serial|isbn|hash|token|id|page|total|sum|score|chapter|sha|commit|build"

EXAMPLES = 1600
ROUNDS, DEPTH, RATE = 24, 2, 0.3
PRECISION = 0.95


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


_NONE = "array<struct<s:int,e:int,b:int,m:string>>"


def scan(x: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of int under `join` (a sum, a maximum), by doubling steps: n log n, whatever the length."""
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    step = lambda acc, k: F.transform(acc, lambda v, i: F.when(i >= back(k), join(v, F.get(acc, i - back(k)))).otherwise(v))
    steps = lambda own: F.sequence(F.lit(0), F.floor(F.log2(F.size(own).cast("double"))).cast("int"))
    return _bind(x, lambda own: F.when(F.size(own) < 2, own).otherwise(F.aggregate(steps(own), own, step)))


def locate(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches the empty string: array of (s, e, b, m), code points from s to e (exclusive), bytes from b."""

    def places(between: Column, found: Column, size: Callable[[Column], Column]) -> Column:
        steps = F.transform(found, lambda m, i: size(F.get(between, i)) + F.when(i > 0, size(F.get(found, i - 1))).otherwise(0))
        return scan(steps, lambda a, c: a + c)

    def spans(between: Column, found: Column) -> Column:
        zipped = F.arrays_zip(places(between, found, F.length).alias("s"), places(between, found, F.octet_length).alias("b"), found.alias("m"))
        return F.transform(zipped, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["b"].alias("b"), x["m"].alias("m")))

    both = F.array(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))
    return F.get(F.transform(both, lambda x: F.when(F.size(x["found"]) == 0, F.array().cast(_NONE)).otherwise(spans(x["between"], x["found"]))), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(value(c.try_cast("int"), i), F.lit(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _quad(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: _bind(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _quad,
    "card": lambda m: _bind(_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Valid base matches: array of (s, k, e, b, m), by start and then kind; k is the kind's place in KINDS."""

    def of(k: int, kind: str) -> Column:
        some = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
        spans = F.when(some, locate(text, BASE[kind])).otherwise(F.array().cast(_NONE))
        return F.transform(F.filter(spans, lambda x: VALID[kind](x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["b"].alias("b"), x["m"].alias("m")))

    return F.sort_array(F.flatten(F.array(*[of(k, kind) for k, kind in enumerate(KINDS)])))


FEATURES = ("digits", "length", "separators", "luhn", "quad", "plus", "at", "good", "bad", "left", "right", "first")


def proposals(text: Column, kind: str) -> Column:
    """Proposed spans of a kind."""
    return F.when(text.rlike(GENERATOR_NEEDS[kind]), locate(text, GENERATORS[kind])).otherwise(F.array().cast(_NONE))


def candidates(text: Column, spans: Column, kind: str) -> Column:
    """Proposed spans of a kind with their features: array of structs. The words around a span are looked up in the text's bytes."""

    def features(x: Column, raw: Column) -> Column:
        m, d = x["m"], _digits(x["m"])
        end = x["b"] + F.octet_length(m)
        # cut bytes may not be UTF-8 at the edge, where they then match nothing
        before = F.lower(F.substring(raw, F.greatest(x["b"] - CONTEXT + 1, F.lit(1)), F.least(x["b"], F.lit(CONTEXT))).cast("string"))
        left = F.when(x["b"] > 0, F.substring(raw, x["b"], F.lit(1)).cast("string")).otherwise(" ")
        right = F.substring(raw, end + 1, F.lit(1)).cast("string")
        yes = lambda c: F.when(c, 1.0).otherwise(0.0)
        values = {
            "digits": F.length(d).cast("double"), "length": (x["e"] - x["s"]).cast("double"), "separators": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
            "luhn": yes(luhn(d)), "quad": yes(_bind(F.translate(m, "[]", ""), lambda q: (F.size(F.split(q, r"\.")) == 4) & _quad(q))), "plus": yes(m.startswith("+")), "at": yes(F.contains(m, F.lit("@"))),
            "good": yes(before.rlike(f"(^|[^a-z])({GOOD_WORDS[kind]})")), "bad": yes(before.rlike(f"(^|[^a-z])({BAD_WORDS})([^a-z]|$)")),
            "left": yes(left.rlike(r"[A-Za-z0-9_/.\"#$=-]")), "right": yes(right.rlike(r"[A-Za-z0-9_/\"%=-]")), "first": yes(m.rlike(r"^[3-6(+]")),
        }
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), m.alias("m"), *[values[f].alias(f) for f in FEATURES])

    return _bind(F.struct(spans.alias("spans"), F.encode(text, "UTF-8").alias("raw")), lambda own: F.transform(own["spans"], lambda x: features(x, own["raw"])))


# ---- training --------------------------------------------------------------------------------------------------------


def _examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int, str]]:
    """(kind, label, text) rows: about n for each kind together, half of them personal."""
    r, out = random.Random(seed), []
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + number(14)
        total = sum(c if i % 2 else c * 2 - 9 * (c > 4) for i, c in enumerate(map(int, reversed(d))))
        d += str(-total % 10)
        return d if r.random() < 0.6 else r.choice(" -").join(d[i : i + 4] for i in (0, 4, 8, 12))

    fill = ["and then", "as we saw", "lorem", "with it", "on monday", "please", "the end", "it says"]
    name = lambda: "".join(r.choice("abcdefghinorst") for _ in range(r.randint(3, 9)))
    phone = lambda: r.choice([f"+{r.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{r.randint(1, 99)} {number(3)} {number(3)} {number(4)}"])
    quad = lambda top, dot=".": dot.join(str(r.randint(0, top)) for _ in range(4))
    groups = lambda n, size: ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, size) if size > 2 else size)) for _ in range(n))
    good = {
        "email": lambda: r.choice(["mail ", "contact ", "write to ", ""]) + r.choice([f"{name()}.{name()}@{name()}.com", f"{name()} at {name()} dot com", f"{name()} (at) {name()}.org"]),
        "ip": lambda: r.choice(["from ", "host ", "client ", "ip ", ""]) + r.choice([quad(255), quad(255, "[.]"), groups(8, 4), f"{groups(r.randint(2, 4), 4)}::{groups(r.randint(1, 3), 4)}"]),
        "card": lambda: r.choice(["card ", "visa ", "paid with ", ""]) + card() + r.choice(["", " " + card(), " " + quad(255)]),
        "phone": lambda: r.choice(["call ", "phone ", "tel ", "reach me on ", ""]) + phone() + r.choice(["", " " + quad(255), " " + card()]),
    }
    bad = {
        "email": lambda: r.choice([f"look at {name()} dot dot", f"we were at {name()}. {name()} went", f"was at {name()} dot dot", f"a point at {name()} dot {name()}"]),
        "ip": lambda: r.choice([r.choice(["version ", "release ", "section ", "build "]) + quad(r.choice([9, 40, 999])), r.choice(["mac ", "host ", ""]) + groups(6, 2), f"page {quad(999, '[.]')}", f"at {r.randint(10, 23)}:{number(2)}:{number(2)}", f"hash {groups(16, 2)}", f"std::{name()}::{name()}"]),
        "card": lambda: r.choice(["order ", "serial ", "isbn ", "hash ", "id ", "total ", ""]) + r.choice([number(16), number(13), number(19), number(15)]),
        "phone": lambda: r.choice(["order ", "serial ", "isbn ", "page ", "sum ", ""]) + r.choice([f"{number(2)}-{number(3)}-{number(3)}", f"{number(4)} {number(4)} {number(4)}", f"{number(3)}.{number(3)}.{number(3)}"]),
    }
    for i in range(n):
        kind, label = KINDS[i % 4], i // 4 % 2
        body = (good if label else bad)[kind]()
        out.append((kind, label, f"{r.choice(fill)} {body} {r.choice(fill)}."))
    return out


def _grow(rows: list[tuple], target: list[float], weight: list[float], depth: int) -> tuple | float:
    """A regression tree as (feature, cut, low, high), or a leaf's Newton step."""
    g, h = sum(target), sum(weight)
    best = None
    if depth:
        for f in range(len(FEATURES)):
            values = sorted({x[f] for x in rows})
            for cut in ((a + b) / 2 for a, b in zip(values, values[1:], strict=False)):
                gl = hl = 0.0
                for x, t, w in zip(rows, target, weight, strict=True):
                    if x[f] <= cut:
                        gl, hl = gl + t, hl + w
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut)
    if best is None or best[0] <= g * g / (h + 1) + 1e-9:
        return g / (h + 1)
    side = [x[best[1]] <= best[2] for x in rows]
    part = lambda v, s: [a for a, b in zip(v, side, strict=True) if b == s]
    return (best[1], best[2], *[_grow(part(rows, s), part(target, s), part(weight, s), depth - 1) for s in (True, False)])


def _value(tree: tuple | float, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(rows: list[tuple], labels: list[int]) -> list:
    """Gradient boosting of the log loss; returns the trees."""
    score, trees = [0.0] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(rows, [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p], DEPTH)
        trees.append(tree)
        score = [s + RATE * _value(tree, x) for s, x in zip(score, rows, strict=True)]
    return trees


def _table(trees: list) -> Column:
    """Trees of depth two as an array of (f0, c0, f1, c1, f2, c2, v0 to v3), one literal: the features and cuts of the root and its sides, and the leaves."""

    def row(tree: tuple | float) -> str:
        whole = lambda t: t if isinstance(t, tuple) else (0, 0.0, t, t)  # noqa: E731  a leaf as a split whose sides are alike
        f0, c0, low, high = whole(tree)
        sides = [whole(low), whole(high)]
        numbers = [f0, c0, *[x for f, c, *_ in sides for x in (f, c)], *[round(RATE * v, 9) for _, _, *vs in sides for v in vs]]
        names = ("f0", "c0", "f1", "c1", "f2", "c2", "v0", "v1", "v2", "v3")
        return "named_struct(" + ", ".join(f"'{n}', {v if n[0] == 'f' else repr(float(v)) + 'D'}" for n, v in zip(names, numbers, strict=True)) + ")"

    return F.expr("array(" + ", ".join(map(row, trees)) + ")")


def _score(trees: list, x: Column) -> Column:
    """Sum of the trees' values for a candidate."""

    def total(own: Column) -> Column:
        side = lambda t, f, c: F.get(own, t[f]) <= t[c]
        value = lambda t: F.when(side(t, "f0", "c0"), F.when(side(t, "f1", "c1"), t["v0"]).otherwise(t["v1"])).otherwise(F.when(side(t, "f2", "c2"), t["v2"]).otherwise(t["v3"]))
        return F.aggregate(_table(trees), F.lit(0.0), lambda a, t: a + value(t))

    return _bind(F.array(*[x[f] for f in FEATURES]), total)


@functools.cache
def _model(app: str) -> dict[str, tuple[list, float]]:
    """For each kind its trees and the least score at which held-out examples are PRECISION pure (infinite if none)."""
    spark = SparkSession.getActiveSession()
    packed = "\u0001".join(f"{k}\u0002{y}\u0002{t}" for k, y, t in _examples())
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(packed), "\u0001"))).select("pos", F.split("col", "\u0002").alias("x")).select("pos", F.get("x", F.lit(0)).alias("kind"), F.get("x", F.lit(1)).cast("int").alias("y"), F.get("x", F.lit(2)).alias("t"))
    out = {}
    found = {k: rows.where(F.col("kind") == k).select("pos", "y", F.explode(candidates(F.col("t"), proposals(F.col("t"), k), k)).alias("c")).select("pos", "y", *[F.col(f"c.{f}") for f in FEATURES]).collect() for k in KINDS}
    for kind, got in found.items():
        got = sorted(got)
        train, held = [x for x in got if x["pos"] // 8 % 4], [x for x in got if not x["pos"] // 8 % 4]
        trees = fit([tuple(x[2:]) for x in train], [x["y"] for x in train])
        scored = sorted(((sum(RATE * _value(t, tuple(x[2:])) for t in trees), x["y"]) for x in held), reverse=True)
        cut, good = math.inf, 0
        for n, (s, y) in enumerate(scored, 1):
            good += y
            if good >= PRECISION * n and (n == len(scored) or scored[n][0] < s):
                cut = s
        out[kind] = (trees, max(cut, 0.0) - 1e-6)
    return out


def quality(spark: SparkSession, examples: list[tuple[str, int, str]]) -> dict[str, dict[str, float]]:
    """Precision and recall of each kind over (kind, label, text) examples.

    Recall: personal texts with a span of the kind, base or added. Precision: personal ones of the texts with an added
    span of the kind (base spans are there by definition, whatever a text means).
    """
    rows = spark.createDataFrame(examples, "kind string, y int, text string")
    has = lambda spans: F.exists(spans, lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]) == F.col("kind"))
    found = find_pii(rows).select("kind", "y", has("pii_spans").alias("any"), has(F.array_except("pii_spans", "pii_base")).alias("added"))
    counts = found.groupBy("kind").agg(F.count_if("added").alias("added"), F.count_if(F.col("added") & (F.col("y") == 1)).alias("right"), F.count_if(F.col("any") & (F.col("y") == 1)).alias("found"), F.count_if(F.col("y") == 1).alias("all"))
    return {r["kind"]: {"precision": r["right"] / max(r["added"], 1), "recall": r["found"] / max(r["all"], 1), "added": r["added"]} for r in counts.collect()}


def _plain(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "b", "m")])


def _keys(spans: Column) -> Column:
    """Start and end of each span in one number."""
    return F.transform(spans, lambda x: F.call_function("shiftleft", x["s"].cast("long"), F.lit(31)) + x["e"])


def _added(text: Column, base: Column, spark: SparkSession) -> Column:
    """Proposals that pass their kind's threshold: array of (s, k, e, b, m). Those of a kind that all are base spans are not looked at."""
    model = _model(spark.sparkContext.applicationId)

    def of(k: int, kind: str, known: Column) -> Column:
        trees, cut = model[kind]

        def rated(spans: Column) -> Column:
            rows = F.transform(candidates(text, spans, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["b"].alias("b"), x["m"].alias("m"), _score(trees, x).alias("r")))
            return F.transform(F.filter(rows, lambda x: x["r"] >= cut), _plain)

        none = F.array().cast("array<struct<s:int,k:int,e:int,b:int,m:string>>")
        return _bind(proposals(text, kind), lambda spans: F.when(F.size(F.array_except(_keys(spans), known)) == 0, none).otherwise(rated(spans)))

    return _bind(_keys(base), lambda known: F.flatten(F.array(*[of(k, kind, known) for k, kind in enumerate(KINDS)])))


#: Kinds whose proposals stay where those of several kinds overlap: the ones of the stricter formats first.
ORDER = ("ip", "card", "email", "phone")


def _add(there: Column, new: Column) -> Column:
    """Spans `there` and those of `new` that overlap none of them, in order; by running extremes, so in n log n."""
    no = F.lit(None).cast("int")

    def clear(rows: Column) -> Column:
        # how far the spans there reach that begin up to a span, and where the next of them begins
        reach = scan(F.transform(rows, lambda x: F.when(x["new"], 0).otherwise(x["e"])), lambda a, c: F.greatest(a, c))
        ahead = F.reverse(scan(F.reverse(F.transform(rows, lambda x: F.when(x["new"], no).otherwise(x["s"]))), lambda a, c: F.least(a, c)))
        own = lambda x, i, m: ~x["new"] | ((F.get(m["reach"], i) <= x["s"]) & F.coalesce(F.get(m["ahead"], i) >= x["e"], F.lit(True)))
        kept = _bind(F.struct(reach.alias("reach"), ahead.alias("ahead")), lambda m: F.filter(rows, lambda x, i: own(x, i, m)))
        return F.transform(kept, _plain)

    tag = lambda spans, is_new: F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "b", "m")], F.lit(is_new).alias("new")))
    both = lambda own: _bind(F.sort_array(F.concat(tag(own["there"], False), tag(own["new"], True))), clear)
    return _bind(F.struct(there.alias("there"), new.alias("new")), lambda own: F.when(F.size(own["new"]) == 0, own["there"]).otherwise(both(own)))


def _merge(base: Column, added: Column) -> Column:
    """Base spans and those proposals that overlap neither them nor a proposal of a kind before theirs in ORDER; by start, kind, end."""
    return F.aggregate(F.array(*[F.lit(KINDS.index(kind)) for kind in ORDER]), base, lambda there, k: _add(there, F.filter(added, lambda x: x["k"] == k)))


def describe(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`documents` with pii_base and pii_spans: arrays of (s, k, e, b, m): start, kind number, end (code points), start in bytes, matched text.

    A null text has none. Columns of these names are replaced, all others pass; rows are judged alone, so repeated rows
    give equal results and an empty table gives an empty one. No shuffle.
    """
    rest = [named(c) for c in documents.columns if c.lower() not in ("pii_base", "pii_spans")]
    (added,) = unused([*documents.columns, "pii_base", "pii_spans"], "__added")
    base, new, merged = _steps(documents.sparkSession.sparkContext.applicationId, text_col, added)
    return documents.select(*rest, base.alias("pii_base")).withColumn(added, new).withColumn("pii_spans", merged).drop(added)


@functools.lru_cache(16)
def _steps(app: str, text_col: str, added: str) -> tuple[Column, Column, Column]:
    """The columns pii_base, the proposals that pass, and pii_spans; kept, as making them takes longer than a short text."""
    text = whole(named(text_col))
    merged = F.when(F.size(added) == 0, F.col("pii_base")).otherwise(_merge(F.col("pii_base"), F.col(added)))
    return base_spans(text), _added(text, F.col("pii_base"), SparkSession.getActiveSession()), merged


def redact(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The result of find_pii with each span in the text replaced by its kind, as `[EMAIL]`; overlapping spans give one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, spans = F.col(text_col), F.col("pii_spans")

    def cut(own: Column) -> Column:
        raw, ends = own["raw"], own["ends"]
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        part = lambda a, n: F.substring(raw, a + 1, n).cast("string")
        piece = lambda x, i: F.when(x["b"] < before(i), F.lit("")).otherwise(F.concat(part(before(i), x["b"] - before(i)), F.get(names, x["k"])))
        return F.concat(F.array_join(F.transform(spans, piece), ""), part(F.element_at(ends, -1), F.octet_length(raw)))

    ends = scan(F.transform(spans, lambda x: x["b"] + F.octet_length(x["m"])), lambda a, b: F.greatest(a, b))
    done = _bind(F.struct(F.encode(text, "UTF-8").alias("raw"), ends.alias("ends")), cut)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))
