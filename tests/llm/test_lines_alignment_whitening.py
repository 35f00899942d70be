"""Line de-duplication, alignment of two tokenizers and whitening against brute force; edge cases of each."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import alignment, line_dedup, whitening
from marketlens.llm.byte_bpe import _byte_of_character
from marketlens.llm.queries import BYTE_BPE, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
BIG = 2**60 + 1
CLASHING = "doc_id long, text string, _doc string, _text int, _pos int, pair int, n long, kept_text int, _r1 int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6) for i, t in rows], CLASHING)


# ---- 11: lines ----------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\v\f\r").translate(small)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    shared = {k: max(d) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(spark, rows):
    return [tuple(r) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(1)
    long = [f"Line number {i} of the Terms, ÄÖ İK \U0001F600 and so on and on {i % 3}" for i in range(30)]
    blanks = ["", " ", "\t", "\r", "\x0b \x0c", " "]
    vary = lambda s: draw.choice(blanks) + draw.choice([s, s.upper(), s.lower(), s]) + draw.choice(blanks)
    rows = [(i, "\n".join(vary(draw.choice(long + ["short", "", "x" * 39, "y" * 40])) for _ in range(draw.randint(0, 12)))) for i in range(120)]
    same(line_rows(spark, rows), brute_lines(rows))
    assert sum(r[2] for r in brute_lines(rows)) > 100


def test_line_dedup_edges(spark):
    line = "a line that is certainly longer than forty characters"
    rows = [(BIG, line), (BIG - 1, line + "\n"), (3, line), (3, "other\n" + line), (4, line + "\n" + line), (None, line), (None, None), (7, ""), (7, ""), (8, "z" * 41)]
    # Ids 3, 4 and two large ones: four documents, whatever rows they have.
    assert all(r[2] == 0 for r in line_rows(spark, rows))
    rows += [(9, line.upper() + "\r")]
    got = line_rows(spark, rows)
    same(got, brute_lines(rows))
    assert (BIG, 1, 0, line) in got and (BIG - 1, 2, 1, "") in got and (None, 1, 1, "") in got and (None, 1, 0, "") in got
    assert line_rows(spark, []) == []


def test_line_dedup_very_long_text_and_hot_line(spark):
    draw = random.Random(2)
    common = ["common line %04d with enough characters to count as long" % i for i in range(1500)]
    rows = [(i, "\n".join(common if i < 6 else [common[0]])) for i in range(400)]
    rows += [(1000, "\n".join(draw.choice([common[j % 1500], f"own {j}"]) for j in range(60_000)))]
    same(line_rows(spark, rows), brute_lines(rows))


def test_hot_keys_are_few_and_the_rest_is_joined(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    lines = ["line %02d that is long enough to be looked at, surely" % i for i in range(8)]
    rows = [(d, "\n".join(lines[: 1 + d % 8])) for d in range(80)]
    same(line_rows(spark, rows), brute_lines(rows))


# ---- 12: alignment ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    back, names = _byte_of_character(), {i: p for p, i in a.get_vocab().items()}
    a_bytes = lambda i: bytes(back[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute_alignment(libraries, text):
    """(A ids, B ids, groups as text, linked id pairs) of a whole text, by comparing byte ranges."""
    a_lib, b_lib, a_bytes, b_bytes = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
        return None
    ends = lambda sizes: np.cumsum(sizes).tolist()
    a_end, b_end = ends([len(a_bytes(i)) for i in a]), ends([len(b_bytes(i)) for i in b])
    groups, links, last, j0 = [], [], 0, 0
    for end in sorted(set(a_end) & set(b_end)):
        inside = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at) if last < e <= end)
        groups.append(inside(a, a_end) + "|" + inside(b, b_end))
        last = end
    for i, x in enumerate(a):
        lo, hi = a_end[i - 1] if i else 0, a_end[i]
        while b_end[j0] <= lo:
            j0 += 1
        j = j0
        while j < len(b) and (b_end[j - 1] if j else 0) < hi:
            links.append((x, b[j]))
            j += 1
    return a, b, ";".join(groups), links, len(groups)


def brute_rows(libraries, rows):
    found = [(i, brute_alignment(libraries, t)) for i, t in rows]
    counts = Counter(k for _, f in found if f for k in f[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, text, links, n_groups = f
        out.append((
            i, len(a), len(b), n_groups, len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(3)
    texts = [
        None, "", " ", "  ", "a  b", " a", "a ", "\n a", "\na", "a\n \n b", "　x  y", "<|endoftext|> hi", "</s> <s>", "I'll don't, it's.", "▁a ▁▁b", "日本 語\U0001F600 x",
        "x\0 y", " " * 40 + "b" + " " * 33, "a" * 900, "x\u0085 y\x1c z\ta", "a \n", "\n\n\n x", "word,\nword; word:x", "don't,stop.", "a\r\nb",
    ]
    return texts + ["".join(draw.choice("ab the\n\té日\U0001F600'1.,  \n") for _ in range(draw.randint(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("frequent", [0, 50, 1 << 18])
def test_alignment_equals_brute_force(spark, libraries, odd, frequent):
    rows = [(BIG if n % 7 == 0 else (None if n % 11 == 0 else n), t) for n, t in enumerate(odd)] + [(5, odd[14]), (5, odd[14])]
    got = [tuple(r) for r in alignment.align(docs_of(spark, rows), BYTE_BPE, PIECES, frequent=frequent).collect()]
    same(got, brute_rows(libraries, rows))


def test_alignment_needs_no_sort_and_no_decoding(libraries, odd, monkeypatch):
    both, unwanted = alignment.aligner(BYTE_BPE, PIECES), lambda *_, **__: pytest.fail("not needed")
    monkeypatch.setattr(alignment.np, "sort", unwanted)
    monkeypatch.setattr(type(both._a), "bytes_of", unwanted)
    for text in odd:
        one, brute = both.align(text), brute_alignment(libraries, text)
        assert (one is None) == (brute is None)
        if one is not None:
            assert (one.a.tolist(), one.b.tolist(), one.groups_text(), len(one.a_cuts)) == (*brute[:3], brute[4])
            assert one.links.tolist() == [a * alignment.PAIR + b for a, b in brute[3]]


def test_alignment_query_equals_brute_force(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r) for r in QUERIES["op12_cross_tokenizer_alignment"][0](spark, SF).collect()], brute_rows(libraries, rows))


def test_pair_counts_and_batches(spark, libraries, odd, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH", 100)
    plain = spark.createDataFrame([(n, t) for n, t in enumerate(odd)], "key int, _text string")
    rows = alignment.aligned_texts(plain, BYTE_BPE, PIECES)
    found = [brute_alignment(libraries, t) for t in odd]
    assert {r["key"]: r["n_links"] for r in rows.collect()} == {n: len(f[3]) if f else 0 for n, f in enumerate(found)}
    got = {r["pair"]: r["n"] for r in alignment.pair_counts(rows, flush=10).collect()}
    assert got == Counter(a * alignment.PAIR + b for f in found if f for a, b in f[3])


def test_alignment_of_long_runs_and_empty_table(spark):
    both = alignment.aligner(BYTE_BPE, PIECES)
    for character in ("a", " ", "\n", "日", "ab "):
        one = both.align(character * 20_000)
        # Groups have no common end inside, so a group of p and q tokens has p + q - 1 links.
        assert len(one.links) == len(one.a) + len(one.b) - len(one.a_cuts) > 0
    assert (alignment._unpack(alignment._pack(one.links)) == one.links).all()
    wide = np.array([70_000 * alignment.PAIR + 5, 3 * alignment.PAIR + 80_000])
    assert (alignment._unpack(alignment._pack(wide)) == wide).all()
    assert alignment.align(docs_of(spark, []), BYTE_BPE, PIECES).collect() == []


# ---- 13: whitening ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, _id int, _x int, _index int, component int, n int, pos int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], VECTORS)


def check_whitened(rows, kept, most=8):
    """``rows`` against a dense recomputation of the ids and vectors in ``kept``."""
    ids, x = [i for i, _ in kept], np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    z = centred @ axes[:, order] / np.sqrt(values[order])
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    got = np.array([[by[i][c + 1]["whitened"] for c in range(len(order))] for i in ids])
    assert np.allclose(np.abs(got), np.abs(z), atol=1e-8) and np.allclose(got.T @ got / n, np.eye(len(order)), atol=1e-8)
    # One sign per component for all rows.
    assert np.allclose(np.abs((got * z).sum(0)), n, rtol=1e-8)
    deviations = ((n * x - s).astype(object) ** 2).sum(1)
    for i, d in zip(ids, deviations):
        for c, share in enumerate(values[order] / values.sum()):
            r = by[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, d) and abs(r["explained"] / share - 1) < 1e-8 and r["identity_error"] < 1e-8


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_whitening_equals_dense_computation(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    draw = np.random.default_rng(4)
    data = (draw.normal(size=(300, 12)) @ draw.normal(size=(12, 12)) + 3).round(5)
    kept = [(BIG + i, v.tolist()) for i, v in enumerate(data)]
    bad = [(1, None), (2, [None] + [1.0] * 11), (3, [float("nan")] + [0.0] * 11), (4, [float("-inf")] + [0.0] * 11)]
    df = vectors_of(spark, kept + bad).repartition(7)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 300 * 8
    check_whitened(rows, kept)


def test_whitening_query(spark):
    rows = QUERIES["op13_embedding_whitening"][0](spark, SF).collect()
    kept = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, kept)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [None])])).collect() == []
    one = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    # Rank one, two lengths, a repeated row and a null id: the second component has no value.
    rows = whitening.whiten(vectors_of(spark, [(None, [1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [3.0, 0.0])])).collect()
    assert len(rows) == 8 and all((r["whitened"] is None) == (r["component"] == 2) for r in rows)
    assert sorted(round(r["whitened"] ** 2, 9) for r in rows if r["component"] == 1) == [round(1 / 3, 9)] * 3 + [3.0]
    # Beyond a long the exact sum of squares has no value; the rest has.
    far = whitening.whiten(vectors_of(spark, [(1, [4e6, 1.0]), (2, [-4e6, 2.0])])).collect()
    assert all(r["deviation"] is None for r in far) and any(r["whitened"] is not None for r in far)
