"""Token counts, byte BPE, packing, language ID and quality against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import byte_bpe, bytewords, language_id, packing, quality, token_counts
from lakemill.llm.queries import tokenizer_file
from lakemill.llm.scratch import sampled

P = pytest.importorskip("public_tokenizers")


def plain_words(text):
    return (text or "").encode().lower().split()


# Words


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["The cat  sat", None, "", "\u00a0x\u2003y \x1c z", "the CAT\tsat", "a b c d e f", " ", "x" * 3_000_000 + " y"]
    data, offs = bytewords.text_bytes(pa.array(texts))
    starts, ends, of = bytewords.word_spans(data, offs)
    got = [[bytes(data[s:e]).lower() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(of[:-1], of[1:])]
    assert got == [plain_words(t) for t in texts]
    hashes = bytewords.span_hashes(data, starts, ends)
    sets = bytewords.shingle_hashes(hashes, of)
    assert (sets[0] == sets[4]).all() and [len(s) for s in sets] == [1, 0, 0, 1, 1, 2, 0, 1]
    assert len(set(hashes[of[5] : of[6]].tolist())) == 6
    assert bytewords.span_hashes(data, starts, ends, fold=False)[0] != hashes[0]


# Token counts


def greedy(word, initial, following):
    n = i = 0
    while i < len(word):
        pieces = following if i else initial
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(4))
def test_longest_match(seed):
    rng = random.Random(seed)
    make = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
    initial, following = {make(4) for _ in range(12)}, {make(4) for _ in range(10)}
    machine = token_counts.LongestMatch(initial, following)
    words = [make(14) for _ in range(400)]
    ends = np.cumsum([len(w) for w in words])
    got = machine.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(w, initial, following) for w in words]


def test_long_words():
    rng = random.Random(9)
    initial, following = {b"ab", b"a", b"abcab"}, {b"a", b"b", b"c", b"bca", b"cabc"}
    machine = token_counts.LongestMatch(initial, following)
    words = [b"a" + bytes(rng.choice(b"abc") for _ in range(n)) for n in (3, 254, 255, 256, 257, 5000)] + [b"a" * 300 + b"x", b"x" * 400, b"ab" * 5_000_000]
    ends = np.cumsum([len(w) for w in words])
    got = machine.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist()[:-1] == [greedy(w, initial, following) for w in words[:-1]] and got[-1] == 1 + 2 * 4_999_999


def test_token_counts(odd_docs, no_docs):
    initial, following = token_counts.pieces_of_model(P.path("piece_bpe_32k.model"))
    machine = token_counts.LongestMatch(initial, following)
    a, b = set(initial), set(following)
    want = []
    for r in odd_docs.collect():
        n = [greedy(w, a, b) for w in (r["text"] or "").encode().split()]
        want.append((r["doc_id"], len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n)))
    assert sorted(map(tuple, token_counts.count_tokens(odd_docs, machine).collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(no_docs, machine).count() == 0


# Byte BPE


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.PrefixBpe.from_rank_file(tokenizer_file("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_as_the_library(bpe, library):
    rng, coder = random.Random(3), byte_bpe.Coder(bpe, P.PATTERN)
    letters = "abcde\u00e9  \t\n'sStT0129\u00b2\u00bd,.!\u00aa\u00ff \x85\xa0\x1c\u4e2d\U0001f600\u0130\u017f"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        pieces = coder.encode(text)
        ids = [int(i) for p in pieces for i in p.split()]
        assert ids == library.encode_ordinary(text) and coder.decode(pieces) == bpe.decode(ids) == text.encode()


def test_long_pieces_are_not_remembered(bpe):
    coder = byte_bpe.Coder(bpe, P.PATTERN)
    for i in range(100_000):
        piece = f"{'x' * 64}{''.join(chr(97 + int(d)) for d in str(i))}"
        coded = coder.encode(piece) if i % 2000 == 0 else [coder._learn(piece)] if i % 500 == 0 else None
        assert coded is None or coder.decode(coded) == piece.encode()
    assert len(coder.decoded) == len(coder.encoded) == 0
    coder.encode("short words again")
    assert len(coder.decoded) == len(coder.encoded) == 3


def test_latin_texts_are_cut_together_as_the_library_cuts_them(bpe, library):
    """The pattern is run for other texts alone, and each distinct piece of a slice is met once."""
    rng, coder, cut = random.Random(8), byte_bpe.Coder(bpe, P.PATTERN), []
    split = coder.split
    coder.split = lambda text: cut.append(text) or split(text)
    letters = "abcdesvtmlrdSTMDÀé×÷ÿµ²½¼0129   \t\n\n.,!-_ß¡­\x85\xa0\x1c\x00\x0b" + "'" * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "'", "a'", "'s", "'", "s", "'r", "e", "  ", " x", "x ", " ", "\n", "中 it's", " 's"]
    for a in range(0, len(texts), 400):
        some = texts[a : a + 400]
        ids = [library.encode_ordinary(t) for t in some]
        assert coder.encode_and_decode(some) == [(len(i), " ".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, some)]
    assert cut == ["中 it's"]
    other = byte_bpe.Coder(bpe, r"\s+|\S+")
    assert [d for *_, d in other.encode_and_decode(texts)] == [t.encode() for t in texts]


def test_append_and_edit(bpe):
    rng = random.Random(4)
    text = byte_bpe.Prefixes(bpe, b"there is a longer piece of text here " * 12)
    for _ in range(60):
        a = rng.randint(0, len(text.data))
        b = min(len(text.data), a + rng.randint(0, 4))
        computed = text.replace(a, b, bytes(rng.choice(b"ab the") for _ in range(rng.randint(0, 5))))
        anew = byte_bpe.Prefixes(bpe, text.data)
        assert text.last == anew.last and text.states == anew.states and text.ids() == anew.ids() and computed <= len(text.data)
    text.append(b" and more")
    assert text.last == byte_bpe.Prefixes(bpe, text.data).last


def test_encode_texts(odd_docs, no_docs, bpe, library):
    rows = byte_bpe.decode_texts(byte_bpe.encode_texts(odd_docs, bpe, P.PATTERN), bpe).collect()
    assert len(rows) == odd_docs.count() and byte_bpe.encode_texts(no_docs, bpe, P.PATTERN).count() == 0
    texts = sorted((r["text"] or "" for r in odd_docs.collect()))
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    for r in rows:
        raw = bytes(r["decoded"])
        ids = library.encode_ordinary(raw.decode())
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


# Packing


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 14)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def check_packing(docs, rows, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    whole = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole.setdefault((r["doc_id"] is None, r["doc_id"] or 0), []).append((r["start"], tuple(ids), r["doc_tokens"]))
    # repeated ids: the pieces of all their texts together
    total = {}
    for null, i, ids in want:
        total.setdefault((null, i), []).extend(ids)
    assert {k: sorted(x for _, ids, _ in v for x in ids) for k, v in whole.items()} == {k: sorted(v) for k, v in total.items()}
    for k, v in whole.items():
        if len([w for w in want if w[:2] == k]) == 1:
            assert [x for _, ids, _ in sorted(v) for x in ids] == total[k] and {n for _, _, n in v} == {len(total[k])}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return 1 - sum(r["length"] for r in rows) / (window * len(sequences))


def test_packing(docs, odd_docs, no_docs):
    file = tokenizer_file("word_bpe_49k.json")
    assert check_packing(docs, packing.pack(docs, file, with_ids=True).collect()) < 0.05
    check_packing(odd_docs, packing.pack(odd_docs, file, with_ids=True, block_rows=4).collect())
    assert packing.pack(no_docs, file).count() == 0


def test_words_as_the_library_and_each_once(monkeypatch):
    """Latin-1 texts are cut as the library cuts them; words that are still met are not encoded again, in later tasks neither."""
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    data, rng = tokenizer_file("word_bpe_49k.json"), random.Random(6)
    coder = packing._coder(data)
    letters = "abcdesvtmlrdSTMD\u00c0\u00e9\u00d7\u00f7\u00ff\u00b5\u00b2\u00bd\u00bc0129  \t\n" + "'" * 4 + ".,!-_\u00df\u00a1\u00ad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "'", "a'", "'s", "'", "s", "'r", "e", " ", "x" * 500 + "'ll" + "\u00e9" * 300, "\u4e2d it's", "<|endoftext|> he'll"]
    for a in range(0, len(texts), 400):
        assert coder.encode(texts[a : a + 400]) == coder._bytes(texts[a : a + 400])
    merges, asked = coder.merges, []
    coder.merges = lambda word: asked.append(word) or merges(word)
    often = [f"often{chr(97 + k)}" for k in range(26)]
    for k in range(100):
        coder.encode([" ".join([*often, *(f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for i in range(20))])])
    coder.merges = merges
    assert all(asked.count(w) == 1 for w in often) and len(coder.known) + len(coder.older) < 700
    assert packing._coder(bytes(bytearray(data))) is coder


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048)
    sizes, counts = np.unique(-(-lengths[lengths < 2048] // 8), return_counts=True)
    sequence, offset = packing.pack_block(lengths, 2048, 8, packing.repeat_shares(dict(zip(sizes.tolist(), counts.tolist())), 256))
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and (used > 0).all() and 1 - used.sum() / (2048 * len(used)) < 0.01
    assert (offset + lengths).max() <= 2048


# Language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.fit(docs.where(~held))
    got = language_id.with_language(docs.where(held), model, keep=("doc_id", "lang"))
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 150 and right > 0.95
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_brute_force(docs):
    """The matrix sums are those of counting n-grams one at a time."""
    import pyarrow as pa

    model = language_id.fit(docs)
    texts = [r["text"] for r in docs.limit(20).collect()] + ["\u00dcber Stra\u00dfe", "a", ""]
    lang, score = model.scores(pa.array(texts))
    for text, got, p in zip(texts, lang, score):
        total, n = np.zeros(len(model.languages)), 0
        for m in (1, 2, 3):
            for k in range(len(text) - m + 1):
                piece = text[k : k + m].encode()
                found = [b for b, _ in language_id.grams(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), model.bits)]
                total, n = total + model.log_p[int(found[m - 1][0])], n + 1
        logit = total / max(n, 1) * model.evidence * max(n, 1) ** 0.5 + model.prior
        want = np.exp(logit - logit.max())
        want /= want.sum()
        assert got == (model.languages[int(want.argmax())] if text else "und") and p == pytest.approx(want.max() if text else 0, abs=1e-6)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = language_id.with_language(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {4, 5, 6, 10} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    none = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.with_language(odd_docs, none).collect()} == {"und"}
    assert language_id.with_language(no_docs, model).count() == 0


def test_many_languages_and_null_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26]}" * 20, f"l{i}") for i in range(200)] + [(900, None, "xx"), (901, "", "yy")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), id_col="doc_id")
    assert len(model.languages) == 200 and not {"xx", "yy"} & set(model.languages)
    import pyarrow as pa

    assert model.scores(pa.array([t for _, t, _ in rows[:200]]))[0] == [x for _, _, x in rows[:200]]
    with pytest.raises(ValueError, match="broadcast"):
        language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=20)


def test_samples_of_any_number_of_rows(spark):
    rows = spark.range(20_000).selectExpr("id", "'same' AS text")
    assert 700 < sampled(rows, ["text", "id"], 1000, 20_000).count() < 1300
    assert sampled(rows, ["text", "id"], 30_000, 20_000).count() == 20_000
    # one row in five million, and so on up to 100 TB of rows: the bound never becomes nothing
    for n in (10**11, 10**15, 10**24):
        sampled(rows, ["text", "id"], 20_000, n).count()
    assert "< 1)" not in sampled(rows, ["id"], 20_000, 10**11)._jdf.queryExecution().optimizedPlan().toString()


# Quality


def test_quality_brute_force(spark):
    """Evidence and score of every document from its features, one text at a time, and the site's shares."""
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    classifier = quality.fit(docs, labels)
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    rows = docs.collect()
    fitted = [r for r in rows if r["doc_id"] in known and r["text"] is not None]
    x = np.concatenate([quality.features(pa.array([r["text"]])) for r in sorted(fitted, key=lambda r: r["doc_id"])])
    y = np.array([known[r["doc_id"]] for r in sorted(fitted, key=lambda r: r["doc_id"])])
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -20, 20)], axis=1)
    slope = z.T @ (y - 1 / (1 + np.exp(-np.clip(z @ classifier.weights, -30, 30)))) - np.array([1e-6, *[2.0] * x.shape[1]]) * classifier.weights
    assert np.abs(slope).max() < 1e-3  # no better weights under the penalised likelihood
    shares = {(r["host"], r["path"]): r["path_share"] for r in quality.site_shares(spark.createDataFrame(
        [(r["source"] or "", r["lang"] or "", known.get(r["doc_id"]), float(1 / (1 + np.exp(-(classifier.evidence(pa.array([r["text"]]))[0] + classifier.prior))))) for r in rows], "host string, path string, y double, p double")).collect()}
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = got[r["doc_id"]]
        evidence, share = float(classifier.evidence(pa.array([r["text"]]))[0]), shares[r["source"] or "", r["lang"] or ""]
        score = 1 / (1 + np.exp(-(evidence + np.log(share / (1 - share)))))
        assert own["evidence"] == pytest.approx(evidence, abs=1e-9) and own["score"] == pytest.approx(score, abs=1e-9) and own["keep"] == (own["score"] >= 0.5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels.where("doc_id % 2 = 0"))
    right, n = got.join(labels.where("doc_id % 2 = 1"), "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count(F.lit(1))).first()
    assert n > 1500 and right > 0.97
    assert got.count() == docs.count()


def test_site_shares_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"h{rng.randint(0, 5)}", f"p{rng.randint(0, 3)}", rng.choice([0.0, 1.0, 1.0, None]), rng.random()) for _ in range(600)] + [("rare", "p", 0.0, 0.5)]
    got = {(r["host"], r["path"]): r for r in quality.site_shares(spark.createDataFrame(rows, "host string, path string, y double, p double")).collect()}
    sums = {}
    for h, p, y, q in rows:
        w = 1.0 if y is not None else quality.UNLABELLED
        for key in ((h, p), h, None):
            n, g = sums.get(key, (0, 0))
            sums[key] = n + w, g + w * (q if y is None else y)
    mean = (sums[None][1] + 0.5) / (sums[None][0] + 1)

    def strength(groups):
        s = sum(n * (g / n - m) ** 2 / (m * (1 - m)) for n, g, m in groups)
        k, total = len(groups), sum(n for n, _, _ in groups)
        free = total - sum(n * n for n, _, _ in groups) / total - (k - 1)
        rho = (s - (k - 1)) / free
        return min(1e4, max(1, 1 / rho - 1)) if rho > 0 else 1e4

    hosts = {h: sums[h] for h in sums if isinstance(h, str)}
    worth = strength([(n, g, mean) for n, g in hosts.values()])
    host = {h: (g + worth * mean) / (n + worth) for h, (n, g) in hosts.items()}
    paths = {k: sums[k] for k in sums if isinstance(k, tuple)}
    worth = strength([(n, g, host[h]) for (h, _), (n, g) in paths.items()])
    for (h, p), (n, g) in paths.items():
        assert got[h, p]["host_share"] == pytest.approx(host[h]) and got[h, p]["path_share"] == pytest.approx((g + worth * host[h]) / (n + worth))
    assert 0.0 < got["rare", "p"]["path_share"] < 1.0


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 0), (4, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd_docs, labels).count() == odd_docs.count()
    rows = quality.judge(odd_docs, labels.limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.judge(no_docs, labels).count() == 0
