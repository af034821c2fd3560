"""Encoding, token files and packing: exact against the tokenizer, round trips, invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexloom.llm import encode, packing, token_file
from lexloom.llm.queries import vocabulary
from tests.llm.helpers import awkward, empty

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["a  b", "a\nb", "a \nb", " a", "b ", "", "a\n\nb", "x<|endoftext|>y", "é́ Ä b", "a\tb c", "don't 'll  we'll", "12 345a", "\x00 a b", "a\x1cb c", "Σ ΑΣ ΑΣ\nΣ", "日本 語\n中", "a\r\nb c", "a b", "İ İ", "  \n ", "\x01 a", "W!! x### ...y", "word. Word, WORD!!\nNext. line"]


@pytest.mark.parametrize(("name", "spaces"), [(BYTE, "leading"), (WORD, "dropped")])
def test_pieces_give_the_tokenizer_s_ids(name, spaces):
    r, e = random.Random(1), encode.PieceEncoder(vocabulary(name), spaces=spaces)
    e.kept = 300
    assert (e.plain is not None) == (name == WORD)
    parts = ["the", "Thing", "éa", "ß", "ªº", "ÿ", "ŀ", " ", " ", " ", "\n", ".", ",", "!!", "'s", "9", "\t", " ", "#", "ing", "<|", "_"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for a in range(0, len(texts), 100):
        want = [x.ids for x in e.tokenizer.encode_batch(texts[a : a + 100], add_special_tokens=False)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts[a : a + 100])] == want


@pytest.mark.parametrize(("name", "spaces"), [(BYTE, "leading"), (WORD, "dropped")])
def test_letters_that_change_in_lower_case_before_signs(name, spaces):
    e = encode.PieceEncoder(vocabulary(name), spaces=spaces)
    assert e.signs_apart
    letters = [chr(c) for c in range(0x80, 0x600) if len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1 or chr(c).isalpha() and (chr(c).lower() != chr(c) or c % 7 == 0)]
    texts = [f"Bu bir {a}{x}{signs} diye {x}{signs}" for x in letters for a in ("", "AL") for signs in (",", ".", "')", "=")] + ["Bu bir AL\u0130, ve NERDES\u0130N\u0130. diye"]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want


def test_latin_words_are_encoded_by_the_merges_alone(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    e, r = encode.PieceEncoder(vocabulary(BYTE), spaces="leading"), random.Random(4)
    letters = [chr(c) for c in range(0x300) if chr(c).isalpha()]
    words = [*letters, *("".join(r.choices(letters, k=r.randint(2, 12))) for _ in range(3000)), "'s", "don't", "\u0249\u0250"]
    texts = [f"{a} {b}{sign}\n{c}" for a, b, c, sign in zip(words, words[1:], words[2:], [".", "", "9"] * len(words), strict=False)]
    assert set(e.bytes) == {32, *map(ord, (x for x in letters if ord(x) < 0x250))}
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want
    t = Tokenizer.from_file(vocabulary(BYTE))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(str(tmp_path / "other.json"))
    assert encode.PieceEncoder(str(tmp_path / "other.json"), spaces="leading").bytes is None


def test_a_pattern_that_joins_letters_and_signs_is_noticed(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(vocabulary(BYTE))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(str(tmp_path / "joined.json"))
    assert not encode.PieceEncoder(str(tmp_path / "joined.json"), spaces="leading").signs_apart


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 20, 31])
def test_bits_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 5001)
    assert (token_file.unpack(token_file.pack(x, bits), len(x), bits) == x).all()
    data = token_file.to_bytes(np.array([3, 9, 11]), np.array([2000, 0, 3001]), x, bits, block=64)
    f = token_file.TokenFile(lambda at, n: data[at : at + n])
    assert (f.document(0) == x[:2000]).all()
    assert len(f.document(1)) == 0
    assert (f.span(1990, 2100) == x[1990:2100]).all()
    with pytest.raises(ValueError):
        token_file.TokenFile(lambda at, n: b"XXXX" + data[at + 4 : at + n])


def test_token_files(spark, monkeypatch):
    docs, path = awkward(spark), vocabulary(BYTE)
    monkeypatch.setattr(token_file, "SHARD_IDS", 50)
    got = token_file.read_token_files(token_file.write_token_files(docs, path, end_id=2)).orderBy("start").collect()
    t, start = encode.encoder(path, "leading").tokenizer, 0
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for (_, text), r in zip(rows, got, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_file.read_token_files(token_file.write_token_files(empty(spark), path, end_id=2)).count() == 0


def down(size, capacity):
    return packing.best_fit([], sorted(range(len(size)), key=lambda i: -size[i]), size, capacity)


def triplets(r, n, capacity):
    """Pieces that fill n bins wholly by threes; best fit decreasing needs about a fifth more."""
    out = []
    for _ in range(n):
        a = r.randint(capacity * 38 // 100, capacity * 49 // 100)
        b = r.randint(capacity // 4, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return r.sample(out, len(out))


def test_best_fit_and_evolution():
    r = random.Random(2)
    for _ in range(20):
        size = [r.randint(1, 100) for _ in range(r.randint(1, 120))]
        people, _ = packing.evolve(size, 100, 1)
        assert sorted(i for own in people[0] for i in own) == list(range(len(size)))
        assert all(sum(size[i] for i in own) <= 100 for own in people[0])
        assert len(people[0]) >= packing.lower_bound(size, 100)
    child = packing.crossover(people[0], people[-1], size, 100, r)
    assert sorted(i for own in child for i in own) == list(range(len(size)))
    assert packing.mutate(people[0], [1] * len(size), 100, r)


def test_crossover_finds_what_best_fit_does_not():
    for seed in range(5):
        size = triplets(random.Random(seed), 20, 1000)
        people, generations = packing.evolve(size, 1000, seed)
        assert generations > 0
        assert len(people[0]) <= 21 < len(down(size, 1000))
    size = np.random.default_rng(1).integers(900, 2000, 1000).tolist()  # two or three to a bin
    assert len(packing.evolve(size, 4096, 1)[0][0]) < len(down(size, 4096))


def test_lower_bound_counts_pieces_that_cannot_meet():
    assert packing.lower_bound([6] * 7, 10) == 7
    assert packing.lower_bound([6, 6, 5, 5, 4, 4], 10) == 3
    assert packing.lower_bound([3] * 10, 10) == 3
    assert packing.lower_bound([10], 10) == packing.lower_bound([1], 10) == 1


def test_islands_evolve_and_send_their_elite(spark):
    seen, rows = [], []
    for cell in range(2):
        rows += [(cell, i, n) for i, n in enumerate(triplets(random.Random(cell), 20, 1000))]
    items = spark.createDataFrame(rows, "cell long, item int, length int")
    got = packing.pack_cells(items, 1000, lambda epoch, islands: seen.append((epoch, islands.collect()))).collect()
    assert len({(x["cell"], x["bin"]) for x in got}) <= 42
    assert all(x["generations"] > 0 for x in seen[0][1])
    assert {x["arrived"] for x in seen[0][1]} == {0}
    assert all(x["arrived"] == packing.POPULATION + 1 for x in seen[1][1])  # its own and a neighbour's best


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 60)
    docs, path = awkward(spark, [f"some words number {i} " * (i % 9) for i in range(60)]), vocabulary(WORD)
    docs = docs.unionByName(docs.where("doc_id = 4").selectExpr("cast(null as long) doc_id", *[c for c in docs.columns if c != "doc_id"]))
    got = packing.pack_documents(docs, path, end_id=1, capacity=64).collect()
    t, want, bins = encode.encoder(path, "dropped").tokenizer, [], defaultdict(list)
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    got_ids = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    assert got_ids == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [a for a, _ in sorted(own)] == ends[:-1]
        assert ends[-1] <= 64
    bound = -(-sum(r["length"] for r in got) // 64)
    assert len(bins) <= bound + 3
    assert packing.pack_documents(empty(spark), path, end_id=1).count() == 0
