"""The ten operators against brute force, round trips and libraries; edge cases of each."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from marketlens.llm import embedding_dedup, packing, quality_rules, resampling, sanitise, sentencepiece_codec, simhash_dedup, toxicity, warc
from marketlens.llm.byte_bpe import byte_bpe
from marketlens.llm.links import cells, components
from marketlens.llm.queries import BYTE_BPE, PIECES
from marketlens.llm.sentencepiece_codec import Vocabulary, decode_documents, encode_documents, piece_codec
from marketlens.llm.token_counts import token_counts, unigram_counter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, node int, _text string, _id int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "x", 3) for i, t in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(3)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n a", "a\n \n b", "　x  y", "<|endoftext|> hi", "I'll don't.", "▁a ▁▁b", "日本 語\U0001F600 x", "x\0 y", " " * 40 + "b" + " " * 33, "a" * 5000]
    return texts + ["".join(draw.choice("ab the\n\té▁日\U0001F600'1.,") for _ in range(draw.randint(1, 60))) for _ in range(400)]


# ---- 1, 3, 5: tokens --------------------------------------------------------------------


def test_byte_bpe_equals_tokenizers(odd):
    real = Tokenizer.from_file(BYTE_BPE)
    for t in [*odd, "<|endoftext|>", "a <|endoftext|><|endoftext|>\n b", "<|endoftext|", " <|endoftext|>  x"]:
        assert np.frombuffer(byte_bpe(BYTE_BPE).encode(t), "<u4").tolist() == real.encode(t, add_special_tokens=False).ids


def test_piece_codec_equals_sentencepiece(odd):
    real, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec(PIECES)
    for t in odd:
        ids = real.encode(t)
        assert mine.encode(t) == ids and mine.decode([*ids, 2]) == real.decode([*ids, 2])
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(6)]
        assert mine.decode(ids) == real.decode(ids)


def test_piece_tables(spark):
    docs = docs_of(spark, [(1, "Hello  world"), (1, "Hello  world"), (None, None), (3, "")])
    ids = encode_documents(docs, PIECES)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in decode_documents(ids, PIECES).collect())
    assert back == [(0, ""), (1, "Hello  world"), (1, "Hello  world"), (3, "")]
    assert encode_documents(empty(spark), PIECES).count() == 0


def test_unigram_counts_equal_the_library(spark, odd):
    v, scores = Vocabulary(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    real = Tokenizer(models.Unigram([(p, scores.get_score(i)) for i, p in enumerate(v.pieces)], 0, True))
    for t in odd:
        want = len(real.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert unigram_counter(PIECES).count(t) == want, t
    got = token_counts(docs_of(spark, [(1, "a b"), (2, None), (None, "")]), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, 2), (2, 0)]
    assert token_counts(empty(spark), PIECES).count() == 0


def test_packing(spark):
    texts = [(i, "word " * (i * 7 % 400)) for i in range(300)] + [(7, "w"), (7, "w"), (None, None), (1000, "long text " * 2000)]
    out = packing.pack_documents(docs_of(spark, texts), BYTE_BPE, with_ids=True).toPandas()
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= 1024
    whole = out[out["doc_id"] == 1000].sort_values("piece")
    ids = np.frombuffer(byte_bpe(BYTE_BPE).encode("long text " * 2000), "<u4").tolist() + [2]
    assert sum(whole["ids"].map(list), []) == ids and (whole["length"].to_numpy()[1:] == 1024).all()
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out["ids"], out["ids_crc32"]))
    assert len(out) == len(texts) + len(whole) - 1
    assert out["sequence_id"].nunique() <= 1.01 * out["length"].sum() / 1024 + 1
    assert packing.pack_documents(empty(spark), BYTE_BPE).count() == 0


def test_best_fit_rounds_equal_one_by_one_best_fit():
    draw = random.Random(1)
    for _ in range(30):
        size = draw.choice([10, 37, 64])
        lengths = [draw.randint(1, size) for _ in range(draw.randint(1, 200))]
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            fitting = [g for g in gaps if g >= n]
            if fitting:
                gaps.remove(min(fitting))
            gaps.append((min(fitting) if fitting else size) - n)
        plan = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, size)
        used = {s for _, _, count, first, _ in plan for s in range(first, first + count)}
        assert len(used) == len(gaps) and sum(p[2] for p in plan) == len(lengths)


# ---- 2: toxicity ------------------------------------------------------------------------


def test_kernel_equals_enumeration():
    def brute(s, t):
        def weights(w):
            codes, out = toxicity._codes([w])[0], {}
            for p in combinations(range(len(codes)), 3):
                if p[2] - p[0] < toxicity.SPAN:
                    key = tuple(codes[list(p)])
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (p[2] - p[0] + 1)
            return out

        a, b = weights(s), weights(t)
        dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
        return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))

    words = ["banana", "bandana", "ab", "anna", "straße"]
    assert np.allclose(toxicity.kernel(words, words), [[brute(s, t) for t in words] for s in words], atol=1e-5)
    assert toxicity.kernel(["stxupid"], ["stupid"])[0, 0] > 0.4 > toxicity.kernel(["garden"], ["stupid"])[0, 0]


def test_toxicity_learns_and_tolerates_gaps(spark):
    draw = random.Random(2)
    syllables = ["re", "an", "the", "ing", "or", "ed", "tion", "ha", "ly", "ou"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[draw.randrange(30)] = draw.choice(["stupid", "worthless", "idiot", "scum"])
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = docs_of(spark, texts)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    held = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("pmod(crc32(string(doc_id)), 4) = 2").collect()}
    assert np.mean([(s >= 0.3) == (i % 4 == 0) for i, s in held.items()]) > 0.97
    odd = docs_of(spark, [(1, "you st.u.p.i.d one"), (2, "i d i o t"), (3, None), (4, ""), (4, ""), (5, "re an the " * 5000)])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert got[1] >= 0.3 and got[2] >= 0.3 and max(got[3], got[4], got[5]) < 0.3
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), known.limit(0))).count() == 0
    assert max(s for _, s in model.sentences("An ed the. You idiot! Re.")) >= 0.3


# ---- 4: quality rules -------------------------------------------------------------------


def base_counts(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    seen, dup, at = set(), 0, {}
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_statistics_and_rules(spark):
    draw = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        words = [draw.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta\n"]) + str(draw.randrange(90)) for _ in range(draw.randint(0, 80))]
        if i % 5 == 0:
            words = [w + "###" for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 5 != 0), 0))
    texts += [(900, None), (901, ""), (902, "a b c d e f g h " * 3), (903, "x\ny\nx\n\nx \n x"), (None, "a"), (902, "a b c d e f g h " * 3)]
    known = spark.createDataFrame([*labels, (None, 0, 0)], "doc_id long, quality int, toxic int")
    judged, rules = quality_rules.judge(docs_of(spark, texts), known)
    got, text = judged.toPandas(), dict(texts)
    assert len(got) == len(texts) and rules
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text[None if np.isnan(r.doc_id) else r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    long = got[(got["n_words"] >= 20) & (got["doc_id"] < 400)]
    assert (long["kept"] == (long["doc_id"] % 5 != 0)).mean() > 0.97
    none, no_rules = quality_rules.judge(empty(spark), known.limit(0))
    assert none.count() == 0 and no_rules == []
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 6: WARC ----------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "é" * 150_000
    rows = [(1, "u1", "a" * 1000), (2, None, "a" * 1000), (9, "u9", "a" * 1000), (3, "u 3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (7, "u7", big), (8, "u8", big), (None, "n", "b\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.archive_folder(spark)
    files = warc.write_archives(pages, folder)
    got = {r["page"]: (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_records(files, folder).collect()}
    want = {}
    for page, _, html in rows:
        data = (html or "").encode()
        to = {1: 9, 2: 9, 7: 8}.get(page)
        want[page] = ("revisit" if to else "response", len(data), hashlib.sha1(data).hexdigest(), to)
    assert got == want
    chunks = warc.read_chunks(spark, files, folder).toPandas()
    parts = chunks[chunks["record"] == warc.record_id(8, 0)].sort_values("chunk")
    assert b"".join(parts["data"]) == big.encode() and len(parts) > 3 and parts["data"].map(len).max() <= warc.CHUNK
    nothing = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert warc.read_records(nothing, folder).count() == 0


# ---- 7, 10: near-duplicates -------------------------------------------------------------


def test_golay_hash_is_complete():
    table, count = simhash_dedup.error_patterns()
    assert set(np.bincount(count).nonzero()[0]) == {1, 6}
    leaders = table[:, 0]
    keys, n = simhash_dedup.golay_indices(leaders)
    for w in (0, 1, 2):
        for c in combinations(range(23), w):
            other, m = simhash_dedup.golay_indices(leaders ^ sum(1 << i for i in c))
            met = np.zeros(2048, bool)
            for i in range(6):
                for j in range(6):
                    met |= (n > i) & (m > j) & (keys[:, i] == other[:, j])
            assert met.all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cells_hold_every_pair_once(spark):
    rows = spark.range(50).selectExpr("int(id % 2) AS key", "id AS x")
    met = cells(rows, "key", F.col("x"), 8).toPandas()
    sizes = met.groupby(["key", "_i", "_j"]).size()
    assert sizes.max() < 50 and set(met["x"]) == set(range(50))
    for key in (0, 1):
        blocks = int(met[met["key"] == key]["_j"].max()) + 1
        assert (met[met["key"] == key].groupby("x").size() == blocks).all()


def plain_print(t):
    t = (t or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(n, pairs):
    low = list(range(n))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    draw = random.Random(6)
    words = ["W%d" % i for i in range(400)]
    texts = []
    for _ in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            if draw.random() < 0.7:
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " \t", "one", "one two", "ÄB c", texts[0], texts[0]]
    got = simhash_dedup.near_duplicates(docs_of(spark, list(enumerate(texts))), block=16).toPandas().set_index("doc_id")
    prints = [plain_print(t) for t in texts]
    assert [int(got.loc[i, "fingerprint"], 16) for i in range(len(texts))] == prints
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert got["component_id"].sort_index().tolist() == linked(len(texts), pairs)
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0
    nameless = simhash_dedup.near_duplicates(docs_of(spark, [(None, "a"), (4, "a"), (None, "b c d")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in nameless) == [(0, 0), (0, 4), (4, 4)]


def test_embeddings_equal_brute_force(spark):
    random_ = np.random.default_rng(8)
    base = random_.standard_normal((60, 16))
    rows = np.vstack([base] + [base[:20] + s * random_.standard_normal((20, 16)) for s in (0.05, 0.1, 0.3)]).astype(np.float32)
    rows = np.vstack([rows, rows[:5], 3 * rows[:2]])
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] * 16]
    data += [(1000 + i, v, 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df, tables=24, bits=6, block=16).toPandas().set_index("vec_id").sort_index()
    x = rows.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in combinations(range(len(x)), 2) if unit[i] @ unit[j] >= 0.9]
    found, want = got["n_links"].sum() / 2, len(pairs)
    assert 0.95 * want <= found <= want
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(x))
    assert (got.loc[range(len(x)), "n_links"].to_numpy() <= degree).all()
    assert (got.loc[1000:, "n_links"] == 0).all() and (got.loc[1000:, "component_id"] == got.loc[1000:].index).all() and got.loc[1000:, "kept"].all()
    assert (got["kept"] == (got.index == got["component_id"])).all()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_the_supplied_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.stack(df.toPandas()["embedding"].to_numpy()).astype(float)
    random_ = np.random.default_rng(1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    other = random_.standard_normal(unit.shape)
    other -= (other * unit).sum(1, keepdims=True) * unit
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.91 * unit + np.sqrt(1 - 0.91**2) * other
    model = embedding_dedup.fit_quantiser(np.vstack([unit, near]), 20, 12)
    assert (model.codes(unit) == model.codes(near)).any(axis=1).mean() >= 0.95


# ---- 8: PII -----------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def spans_of(t):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_plain_patterns(spark):
    draw = random.Random(9)
    texts = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.003.4", "+1 (456) 555-2186 +12 +1234567", "4041894974608795 4041-8949-7460-8795 1 2", "@@a@b.c@d.e", "", None, "é\U0001F600 x@y.z1 12.12.12.12", "a" * 30000, "1" * 30000, "a.b" * 9000 + "@x" + ".y" * 9000]
    texts += ["".join(draw.choice("ab1 2.34@+-(5)é\n") for _ in range(80)) for _ in range(300)]
    found = sanitise.find(docs_of(spark, list(enumerate(texts)))).select("doc_id", sanitise.span_text(F.col("base")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in found.collect()} == {i: spans_of(t) for i, t in enumerate(texts)}
    assert sanitise.find(empty(spark)).count() == 0 and sanitise.clean(empty(spark)).count() == 0


def test_disclosing_terms_are_generalised_or_removed(spark):
    filler = ["lorem ipsum dolor %d sit amet" % i for i in range(300)]
    texts = [f"{f} please write w{i} to Zorbax anna@x.org about it" for i, f in enumerate(filler[:6])] + [f"{f} please write to somebody about it" for f in filler[6:]] + [None, ""]
    docs = docs_of(spark, list(enumerate(texts)))
    found = {r["doc_id"]: [(t["action"], t["value"]) for t in r["terms"]] for r in sanitise.find(docs).collect()}
    assert all(("removed", "Zorbax") in found[i] and all(v != "please" for _, v in found[i]) for i in range(6))
    assert all(not found[i] for i in range(6, len(texts)))
    cleaned = {r["doc_id"]: r for r in sanitise.clean(docs).collect()}
    assert cleaned[0]["text"].startswith("lorem ipsum dolor 0 sit amet please write ") and "<EMAIL>" in cleaned[0]["text"]
    assert "Zorbax" not in cleaned[0]["text"] and "anna" not in cleaned[0]["text"] and cleaned[0]["key"] == 1
    assert cleaned[50]["text"] == texts[50] and cleaned[len(texts) - 2]["text"] is None
    plan = sanitise.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _terms_found(spark, texts, **thresholds):
    return [{(t["action"], t["value"]) for t in r["terms"]} for r in sanitise.find(docs_of(spark, list(enumerate(texts))), **thresholds).orderBy("doc_id").collect()]


def test_disclosing_terms_are_found_in_whole_documents(spark):
    far = " ".join(["please write to us about it"] * 3)
    texts = [f"lorem {i} Zorbax, 李明 77120 {far} anna@x.org {far} (Zorbax)" for i in range(6)] + ["a note on Zorbax"] + [f"lorem {i} {far}" for i in range(300)]
    rows = sanitise.find(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for r in rows[:6]:
        want = [(m.start(), m.end()) for m in re.finditer("Zorbax|李明|77120", texts[r["doc_id"]])]
        assert [(t["start"], t["end"]) for t in r["terms"] if t["value"] in ("Zorbax", "李明", "77120")] == want
    assert [t["value"] for t in rows[6]["terms"]] == ["Zorbax"] and not rows[50]["terms"]
    cleaned = [r["text"] for r in sanitise.clean(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert all("Zorbax" not in t for t in cleaned) and cleaned[50] == texts[50]


def test_terms_are_read_from_words_and_the_text_is_split_once(spark):
    # The lower case of the last letter of the name ends in a mark, which is part of the term all the same.
    texts = ["see al\u0130 x@y.zz, (good-by) one", "the \"al\u0130\" x@y.zz two", "good-by three", "four ...", "", None, "- five"]
    docs = docs_of(spark, list(enumerate(texts)))
    found = sanitise.find(docs)
    assert [[(t["action"], t["value"], t["start"], t["end"]) for t in r["terms"]] for r in found.orderBy("doc_id").collect()] == [
        [("removed", "al\u0130", 4, 7)], [("removed", "al\u0130", 5, 8)], [], [], [], [], [],
    ]
    last_step = found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert "_wanted" in last_step and last_step.count("split(") == 1


def test_copies_do_not_hide_a_disclosing_term(spark):
    texts = ["lorem Zorbax anna@x.org first"] * 400 + ["ipsum Zorbax anna@x.org second"] + [f"lorem ipsum {i} first second" for i in range(300)]
    found = _terms_found(spark, texts)
    assert found[0] == found[400] == {("removed", "Zorbax")}


def test_frequencies_count_the_terms_that_are_looked_for(spark):
    texts = [f"w{i} don't by-nc anna@x.org e-mail" for i in range(3)] + [f"w{i} don't, (by-nc) E-MAIL" for i in range(3, 300)]
    assert not any(_terms_found(spark, texts))
    draw = random.Random(12)
    words = "alpha don't by-nc foo_bar 李明 42 zeta-9 x eta".split()
    texts = [" ".join([*draw.choices(words, k=3), *draw.choices(["a@b.c", "d@e.f", "..", "q"], k=2)]) for _ in range(400)]
    sets = {t: ({w for w in t.split() if "@" not in w and w != ".."}, {w for w in t.split() if "@" in w}) for t in texts}
    want = {}
    for e in ("a@b.c", "d@e.f"):
        for t in {*words, "q"}:
            both, n_e, n_t = (sum(f(v) for v in sets.values()) for f in (lambda v: e in v[1] and t in v[0], lambda v: e in v[1], lambda v: t in v[0]))
            want["email:" + e, t] = np.log2(both * len(sets) / (n_e * n_t)) / np.log2(len(sets) / n_e)
    got = sanitise.disclosing_terms(sanitise.distinct_texts(docs_of(spark, list(enumerate(texts)))), generalise=0.02, remove=0.05).collect()
    assert {(r["entity"], r["term"]): pytest.approx(r["share"]) for r in got} == {k: v for k, v in want.items() if v >= 0.02} and got


# ---- 9: resampling ----------------------------------------------------------------------


def test_resampling_prefers_the_target(spark):
    draw = random.Random(10)
    word = lambda: draw.choice("alpha beta gamma delta zeta eta theta iota".split())
    texts = [(i, " ".join(word() + ("!!" if i % 5 == 0 else "") for _ in range(60))) for i in range(500)] + [(600, None), (601, ""), (None, "beta")]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 500, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = resampling.resample(docs, labels, buckets=4096).toPandas()
    assert len(got) == len(texts) and got["kept"].sum() == round(len(texts) * 201 / 251)
    junk = got["doc_id"].between(0, 499) & (got["doc_id"] % 5 == 0)
    assert got[junk]["kept"].mean() < 0.1 < 0.9 < got[~junk]["kept"].mean()
    raw = np.sum([resampling.bucket_counts(t, 4096) for _, t in texts], axis=0)
    counted = {r["bucket"]: r["n_raw"] for r in resampling.models(docs, spark.createDataFrame([(1,), (2,)], "_target long"), 4096).collect()}
    assert counted == {int(b): int(raw[b]) for b in np.flatnonzero(raw)}
    assert resampling.resample(empty(spark), labels.limit(0)).count() == 0
    long = "alpha beta " * 400_000
    assert resampling.bucket_counts(long, 64).sum() == 2 * 800_000 - 1


# ---- pipeline and queries ---------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == list(pipeline.COLUMNS) and set(after.dtypes) == set(docs.dtypes)
        ids = {r[0] for r in before.select("doc_id").collect()}
        kept = [r[0] for r in after.select("doc_id").collect()]
        assert set(kept) <= ids and (name == "pii") <= (len(kept) == len(ids))
        before = after
        before = before.sparkSession.createDataFrame(before.collect(), docs.schema)
    packed = pipeline.pack(spark, before, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
    texts = [r["text"] for r in before.collect()]
    assert not any(spans_of(t) for t in texts) and len({plain_print(t) for t in texts}) <= len(texts)


def test_pipeline_keeps_one_document_of_a_class_without_ids(spark):
    import corpus_pipeline as pipeline

    docs = docs_of(spark, [(None, "one two three"), (None, "one two three"), (None, None), (8, "four five six"), (None, "four five six"), (8, "four five six")])
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == [(0, ""), (0, "one two three"), (8, "four five six")]


def test_ids_survive_beside_null_and_draws_beside_anything(spark, odd):
    """A large id, a null one and a repeated one in one batch, from every operator that runs Python on rows."""
    big = 2**60 + 1
    rows = [(big, "alpha beta"), (None, "gamma"), (7, "beta"), (7, "beta"), (big + 2, None)]
    docs = docs_of(spark, rows).coalesce(1)
    want = sorted((r[0] for r in rows), key=repr)
    ids = lambda df, name="doc_id": sorted((r[name] for r in df.collect()), key=repr)
    digest = lambda found, text: (len(found), "", text)
    assert ids(token_counts(docs, PIECES)) == want and ids(sentencepiece_codec.round_trip(docs, PIECES, digest)) == want
    assert ids(encode_documents(docs, PIECES)) == want and ids(decode_documents(encode_documents(docs, PIECES), PIECES)) == want
    assert ids(packing.pack_documents(docs, BYTE_BPE)) == want and ids(packing.pack_documents(docs, BYTE_BPE, with_ids=True)) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/y").alias("url"), F.when(F.col("text").isNull(), F.col("text")).otherwise("z" * 2000).alias("html"))
    folder = warc.archive_folder(spark)
    found = warc.read_records(warc.write_archives(pages, folder), folder)
    assert ids(found, "page") == want and ids(found.where("refers_to is not null"), "refers_to") == [big] * 3
    labels = spark.createDataFrame([(big, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    draws = [sorted((tuple(r) for r in resampling.resample(docs.repartition(n), labels, buckets=64).collect()), key=repr) for n in (1, 7)]
    assert [r[0] for r in draws[0]] == want and draws[0] == draws[1]
    alone = {r["doc_id"]: r["gumbel"] for r in resampling.resample(docs.where("doc_id = 7"), labels, buckets=64).collect()}
    assert alone[7] in {r[2] for r in draws[0] if r[0] == 7}


def test_reader_is_bounded_by_chunks(spark):
    """A payload that packs a thousand to one comes back in chunks."""
    pages = spark.createDataFrame([(1, "u", "a" * 20_000_000)], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    path = warc.write_archives(pages, folder).first()["path"]
    with warc._opened(path, folder) as stream:
        reader = warc._Reader(stream)
        most = 0
        while reader.until(b"\r\n\r\n") is not None:
            for part in reader.take(1 << 20):
                most = max(most, len(part), len(reader._held))
            break
    assert most <= 2 * warc.CHUNK
    assert warc.read_records(spark.createDataFrame([(path,)], "path string"), folder).first()["payload_bytes"] == 20_000_000


def test_warc_chunk_rows_of_a_payload_beyond_every_batch(spark):
    """40 MB in one record: rows of at most a chunk, batches of bounded bytes, digests that grow with them."""
    data = ("0123456789abcdef" * (1 << 16) + "é") * 40
    pages = spark.createDataFrame([(1, "u", data), (2, "v", ""), (2, "v", ""), (3, None, None)], "page_id long, url string, html string")
    pages = pages.withColumns({"chunk": F.lit("x"), "last": F.lit(5), "digest": F.lit(None)}).coalesce(1)
    rows = warc.chunked(warc.with_references(pages, "page_id", "url", "html", 1000))
    sizes = rows.mapInArrow(lambda batches: ((pa.RecordBatch.from_pydict({"n": [b.nbytes], "most": [max(map(len, b.column("data").to_pylist()))]})) for b in batches), "n long, most long")
    with warc._batches_of(spark, warc.BATCH):
        most, n = sizes.agg(F.max("most"), F.max("n")).first()
    assert most == warc.CHUNK and n <= 1.1 * warc.BATCH
    folder = warc.archive_folder(spark)
    files = warc.write_archives(pages, folder)
    chunks = warc.read_chunks(spark, files, folder).where("page = 1").toPandas().sort_values("chunk")
    whole = data.encode()
    assert b"".join(chunks["data"]) == whole and list(chunks["chunk"]) == list(range(-(-len(whole) // warc.CHUNK)))
    assert list(chunks["bytes"]) == list(chunks["data"].map(len).cumsum()) and list(chunks["last"]) == [False] * (len(chunks) - 1) + [True]
    assert chunks["digest"].iloc[-1] == hashlib.sha1(whole).hexdigest() and chunks["digest"].iloc[:-1].isna().all()
    ends = sorted((r["page"], r["payload_bytes"], r["record_type"]) for r in warc.read_records(files, folder).collect())
    assert ends == [(1, len(whole), "response"), (2, 0, "response"), (2, 0, "response"), (3, 0, "response")]


def test_warc_reading_task_holds_a_bounded_batch(spark):
    """Batches of the reader, taken one by one from a file with a payload of 30 MB."""
    folder = warc.archive_folder(spark)
    path = warc.write_archives(spark.createDataFrame([(1, "u", "ab" * 15_000_000)], "page_id long, url string, html string"), folder).first()["path"]
    with warc._opened(path, folder) as stream:
        rows = list(warc._chunk_rows(stream))
    assert max(len(r[-1]) for r in rows) <= warc.CHUNK and sum(len(r[-1]) for r in rows) == 30_000_000
    sizes = warc.read_chunks(spark, spark.createDataFrame([(path,)], "path string"), folder)
    assert sizes.count() == len(rows)


def test_warc_files_are_read_by_a_task_each(spark):
    folder, files = warc.archive_folder(spark), []
    for start in (0, 10, 20, 30):
        pages = spark.range(start, start + 10).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
        files += warc.write_archives(pages, warc.archive_folder(spark)).collect()
    found = warc.read_records(spark.createDataFrame(files), folder).select("page", F.spark_partition_id().alias("task"))
    assert len(files) >= 4 and found.select("task").distinct().count() == len(files) and found.count() == 40


def test_long_strings_are_cut_into_parts_of_bounded_size():
    """Strings with many subsequences go through the kernel in small parts, short ones in large parts; none is lost."""
    from marketlens.llm import toxicity

    words = ["".join(chr(97 + (i * 7 + k * k) % 26) for k in range(n)) for i in range(3000) for n in (4, 32)]
    seen = []
    for at, part in toxicity._by_length(words):
        assert [words[i] for i in at] == part
        assert len(part) * len(toxicity._triples(len(part[0]))[1]) <= 1 << 18
        seen += at.tolist()
    assert sorted(seen) == list(range(len(words)))
