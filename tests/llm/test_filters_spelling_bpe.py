"""Filter audit, spelling variants and byte-level BPE, held to plain Python and to the tiktoken library."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leasegrid.llm import audit, bpe, queries, spelling

DOCS = "doc_id long, text string, source string, part string, digest string, fails int, word string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", None, 7, "w") for r in rows], DOCS)


# --- filters


def audit_by_hand(rows, labels):
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows)
        own = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller]
        good, toxic = (any(j == i and i is not None and x == 1 for j, x in ((j, lab[k]) for j, *lab in labels)) for k in (0, 1))
        fails.append((s or "", {c for c, f in zip("ABCDE", own) if f}, good, toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                own = [f for f in fails if f[0] == part]
                removed = [f for f in own if x in f[1] and not f[1] & before]
                shapley[part, x] += len(removed)
                out[part, order, step] = (
                    sum(not f[1] & (before | {x}) for f in own), len(removed), sum(x in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {x} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed),
                )
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


AUDIT_ROWS = [
    (1, "Word " * 250, "a"), (2, "word " * 250, "a"), (2, "word " * 250, "a"), (3, "word " * 250, "b"), (None, "word " * 250, "a"), (4, None, "a"),
    (5, "", None), (6, " ".join(f"w{k}" for k in range(200)), ""), (6, "SHOUTED | text", "a"), (7, " ".join(f"w{k}" for k in range(199)) + " $", "a"),
    (8, "a b\x1cc", "b"), (9, "ÀÉ A" + "x" * 46, "b"), (-5, "", "b"), (10, " ".join(f"w{k % 100}" for k in range(200)), "c"),
    (11, " ".join(f"w{k % 99}" for k in range(200)), "c"), (12, "long" * 100_000, "c"),
]
AUDIT_LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (7, None, None), (99, 1, 1), (None, 1, 1)]


def test_audit_is_that_of_every_order(spark):
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int").withColumn("source", F.lit("q"))
    got = audit.audit(documents(spark, AUDIT_ROWS), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 4 * 600
    assert set(rows) == audit_by_hand(AUDIT_ROWS, AUDIT_LABELS)


def test_audit_of_no_rows_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, []), none).count() == 0
    got = audit.audit(documents(spark, AUDIT_ROWS[:2]), none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(got) == (0, 0)


def test_equal_hashes_do_not_make_texts_equal(spark, monkeypatch):
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    got = audit.failures(documents(spark, [(1, "one", "a"), (2, "two", "a"), (3, "one", "a")]))
    assert {r.doc_id: r.fails & 16 for r in got.collect()} == {1: 0, 2: 0, 3: 16}


def test_copies_meet_one_row_only(spark):
    """A hot text joins with its first id, not with its copies."""
    rows = audit.failures(documents(spark, [(k, "copy", "a") for k in range(3000)]))
    assert rows.where("fails >= 16").count() == 2999
    text = rows._jdf.queryExecution().toString()
    assert "LeftSemi" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_op11_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in queries.op11_filters(spark, folder).collect()} == audit_by_hand(docs, labels)


# --- spelling


def spelling_by_hand(rows, factor=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return variants_by_hand({w: k for w, k in n.items() if len(w) >= 7 and k >= 2}, factor)


def variants_by_hand(n, factor=10):
    lacking, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            lacking[k, w[:k] + w[k + 1 :]].add(w)
    for (_, rest), group in lacking.items():
        for a in group:
            near[a] |= group - {a}
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w in n:
        if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= factor * n[w]:
            form[w] = b
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_variants_of_crowded_words(spark, monkeypatch):
    """Words of few letters, so that keys are full, with every limit on what meets giving the same."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab" if k % 3 else "abé") for _ in range(rng.randint(7, 11))): rng.choice([2, 5, 30, 400, 5000]) for k in range(900)}
    words |= {"prefixes" + "".join(rng.choice("abcdefgh") for _ in range(4)): 3 for _ in range(600)} | {"x" * 5000: 9, "x" * 5001: 90, "x" * 4999 + "y": 1000}
    table = spark.createDataFrame([(w, n, "clash") for w, n in words.items()], "word string, n long, long string")
    want = variants_by_hand(words)
    for limit in (64, 2):
        monkeypatch.setattr(spelling, "MEET", limit)
        got = [tuple(r) for r in spelling.variants(table).collect()]
        assert len(got) == len(want) and set(got) == want


def test_roots_follow_forms_to_the_last(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"aabbbbb"} and {tuple(r) for r in got} == variants_by_hand(words)


def test_words_of_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Sprache", "sprachen", "SPRÄCHE", "sprächen", "ÄRGERNISSE", "Ärgernisse", "kurz", "x×y÷zabc", "naïveté9naïveté"]) for _ in range(60)) for _ in range(40)]
    rows = [(k // 2 - 3, t, "s") for k, t in enumerate(texts)] + [(None, texts[0], "s"), (1, None, "s"), (2, "", "s"), (3, "q" * 70_000 + " " + "q" * 70_000, None)]
    got = [tuple(r) for r in spelling.variants(spelling.word_counts(documents(spark, rows))).collect()]
    want = spelling_by_hand([r[:2] for r in rows])
    assert len(got) == len(want) > 10 and set(got) == want
    assert spelling.variants(spelling.word_counts(documents(spark, []))).count() == 0


def test_op12_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_spelling(spark, folder).collect()} == spelling_by_hand(rows)


# --- byte-level BPE


@pytest.fixture(scope="module")
def multi():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, tokenizers.PATTERN, bpe.Vocabulary(ranks), library


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pools = [
        [chr(c) for c in range(32, 127)], [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], list("abe' \n\t\r\u0085 tsrmdlv1०²"), list("aab"),
        [chr(c) for c in range(0xC0, 0x600)], [chr(c) for c in range(0x4E00, 0x9FFF)], ["'s", "'S", "'ll", " ", "  ", "\n", "ſ", "<|endoftext|>"],
    ]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for pool in (rng.choice(pools) for _ in range(n))]


def test_ids_are_the_librarys(multi):
    _, pattern, vocabulary, library = multi
    texts = [*random_texts(8000), "a" * 50_000, "ab" * 20_000, " " * 5000 + "x", "é" * 9000, ""]
    for text, ids in zip(texts, bpe.Encoder(vocabulary, pattern).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_classes_of_every_code_point(multi):
    """A letter, a number and a mark before each code point tell its class: one part or two."""
    import tiktoken

    _, pattern, _, _ = multi
    newer = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c > 0xA000)][::7]
    pairs = [p + c for c in newer for p in "a1!"]
    ranks = {bytes([b]): b for b in range(256)}
    for p in pairs:
        ranks.setdefault(p.encode(), len(ranks))
    library = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    split = bpe.Splitter(pattern)
    assert [p for p in pairs if (len(split(p)) == 1) != (len(library.encode_ordinary(p)) == 1)] == []


def test_words_that_leave_rank_order():
    """Vocabularies in which a merge makes a pair of lower rank than its own."""
    import tiktoken

    rng = random.Random(2)
    left = 0
    for _ in range(60):
        tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)})
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens)}
        library = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) for _ in range(200)})
        vocabulary = bpe.Vocabulary(ranks)
        plain = vocabulary.alone
        vocabulary.alone = lambda w, f=plain: (counted.append(w), f(w))[1]
        counted = []
        for word, ids in zip(words, bpe.Encoder(vocabulary, r"\S+").encode(words), strict=True):
            assert ids.tolist() == library.encode_ordinary(word)
        left += len(counted)
    assert left > 100  # the way round is used


def test_encode_and_decode_tables(spark, multi, monkeypatch):
    path, pattern, _, library = multi
    texts = [None, "", *random_texts(60, seed=4), "repeated", "repeated", "z" * 300_000]
    rows = [(k // 2 if k % 5 else None, t, None) for k, t in enumerate(texts)]
    docs = documents(spark, rows).withColumn("others", F.lit("o")).withColumn("ids", F.lit("gone")).withColumn("decoded", F.lit("too"))
    for known in (400_000, 0):
        monkeypatch.setattr(bpe, "KNOWN_WORDS", known)
        encoded = bpe.encode(docs, path, pattern)
        assert set(encoded.columns) == set(docs.columns) - {"text"}
        back = bpe.decode(encoded, path).collect()
        want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode(), "o") for i, t, _ in rows)
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded), r.others) for r in back) == want
    only_text = bpe.encode(docs.select("text"), path, pattern)
    assert only_text.columns == ["ids"] and only_text.count() == len(texts)
    assert bpe.decode(bpe.encode(docs.limit(0), path, pattern), path).count() == 0


def test_op13_query(spark, multi):
    library = multi[3]
    folder = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op13_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
