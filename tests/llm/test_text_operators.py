"""Decontamination, packing, language, model scoring, near-duplicates, shards, suffix dedup and quality
on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leasegrid.llm import decontaminate, langid, lm, packing, quality, sharding, simhash, suffix
from leasegrid.llm.queries import tokenizer_path

BLANKS = re.compile("[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, hits string, at long, row string, part string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in BLANKS.split(lowered(text)) if w]


def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéüß") for _ in range(r.randint(1, 6))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = say(40)
    out = [None, "", "   \n\t", "x", "Two words", "!!! ... 123", say(30), say(5000), passage, "Before " + passage + " after", say(10) + "\n" + passage]
    out += [out[6]] * 4 + [out[6] + " end", out[6].replace("a", "b", 1)] + [say(r.randint(1, 60)) for _ in range(40)]
    return out


def frame(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    rows = [*rows, (3, "x"), (None, "no id, but a text that is long enough to have words of its own")] if rows else rows
    return spark.createDataFrame([(i, t, "hits", 1, "row", "part") for i, t in rows], DOCS), rows


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_decontaminate_finds_every_window(spark):
    docs, rows = frame(spark)
    passage = rows[8][1]
    items = [(0, passage), (1, "Two words"), (2, None), (3, ""), (4, "x"), (5, " ".join(passage.split()[3:15]).upper()), (0, passage)]
    table = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall(lowered(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w = word.findall(lowered(t))
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    for block in (1 << 20, 25):  # in one block, and in several
        got = listed(decontaminate.report(decontaminate.decontaminate(docs, table, block_words=block)))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[5] for x in want)
    assert all(r.n_hit == 0 for r in decontaminate.report(decontaminate.decontaminate(docs, table.limit(0))).collect())
    assert listed(decontaminate.decontaminate(frame(spark, [])[0], table)) == []


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs, rows = frame(spark)
    extra = [(900, "it's 12,3 don't 'S ''s ,'s H̱x É <|endoftext|> ab"), (901, "A\x1cb\x85c \x0b d"), (902, "漢字 кириллица 🙂 á")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "h", 1, "r", "p") for i, t in extra], DOCS))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in [*rows, *extra]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128))]
    got = packing.pack_documents(docs, tokenizer_path(), 128).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 128 + 1
    assert listed(packing.pack_documents(frame(spark, [])[0], tokenizer_path())) == []


@pytest.mark.parametrize("seed", range(3))
def test_a_sweep_matches_like_the_sequential_one(spark, seed):
    r = random.Random(seed)
    docs = [(i, r.randint(1, 32)) for i in range(r.randint(1, 300))]
    gaps = [(1000 + i, r.randint(1, 64)) for i in range(r.randint(0, 300))]
    stack, want = [], []
    for size, kind, ref in sorted([(-s, 1, i) for i, s in docs] + [(-s, 0, i) for i, s in gaps]):
        if kind == 0:
            stack.append((ref, -size))
        elif stack:
            seq, room = stack.pop()
            want.append((-size, room))
    table = lambda x: spark.createDataFrame(x, "ref long, size long")
    swept = packing.settled(packing.sweep(table(docs), table(gaps), 64, 64, 5))
    left = {}
    for x in swept.where("part is not null").collect():
        d, g = left.get(x.part, (0, 0))
        left[x.part] = (d + 1, g) if x.kind == packing.DOC_LEFT else (d, g + 1)
    after, open_gaps, more = packing.settle_conflicts(swept, packing.conflicts(left), 64)
    sizes = dict(docs)
    placed = swept.where(f"kind = {packing.PLACED}").select("ref", "seq", "at")
    placed = (placed if more is None else placed.union(more)).collect()
    assert sorted((sizes[x.ref], 64 - x.at) for x in placed) == sorted(want)
    assert len({x.seq for x in placed}) == len(placed) and after.count() == len(docs) - len(placed)
    assert open_gaps.agg(F.sum("size")).first()[0] == (sum(s for _, s in gaps) - sum(sizes[x.ref] for x in placed) or None)


@pytest.mark.parametrize("sizes", [[64] * 5, [1] * 200, [33, 31] * 20, [20] * 50, [None, 0, 0, 1, 200], [], [17, 16, 15] * 40 + list(range(1, 64))])
def test_packing_is_tight(spark, sizes):
    got = packing.pack(spark.createDataFrame([(i, s, -1) for i, s in enumerate(sizes)], "id long, length int, offset int"), 64).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    own = {}
    for r in got:
        own.setdefault(r.sequence_id, []).append((r.offset, r.length or 0))
    for rows in own.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 64 or len(rows) == 1
    total = sum(min(s or 0, 64) for s in sizes)
    assert len(own) <= 1.2 * total / 64 + 1


def test_language_profiles(spark):
    r = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàçù"}
    make = lambda a: " ".join("".join(r.choice(alphabets[a]) for _ in range(r.randint(1, 7))) for _ in range(20))
    rows = [(i, make(a), a) for i, a in enumerate(list(alphabets) * 30)]
    table = spark.createDataFrame(rows + [(900, "text", None), (901, None, "aa")], "doc_id long, text string, lang string")
    profiles = langid.learn(table)
    assert (profiles.groupby("lang").size() <= langid.PROFILE).all()
    tests = spark.createDataFrame([(i, make(a)) for i, a in enumerate(list(alphabets) * 10)] + [(100, None), (101, ""), (102, "12 34 !!"), (None, make("bb"))], "doc_id long, text string")
    got = {x.doc_id: x for x in langid.identify(tests, profiles).collect()}
    assert all(got[i].lang_pred == a and 0 < got[i].score <= 1 for i, a in enumerate(list(alphabets) * 10))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[None].lang_pred == "bb"
    assert {x.lang_pred for x in langid.identify(tests, langid.learn(table.limit(0))).collect()} == {"und"}
    assert listed(langid.identify(tests.limit(0), profiles)) == []


def test_language_stage_without_any_lang(spark):
    table = spark.createDataFrame([(1, "clean words", None), (2, None, None), (3, "12 !!", None), (4, "é", None), (5, "", None)], "doc_id long, text string, lang string")
    kept = langid.with_language(table, langid.learn(table))
    assert sorted(listed(kept)) == [(1, "clean words", None), (4, "é", None)]


def test_language_stage_decides_by_profile(spark):
    r = random.Random(6)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    known = [(i, make("abcde" if i % 2 else "vwxyz", 40), "aa" if i % 2 else "vv", "a") for i in range(60)]
    odd = [(100, make("abcde", 40), None, "b"), (101, make("жщюяэ", 40), None, "c"), (102, make("жщюяэ", 40), "aa", "d"), (103, "жщ", None, "e"), (104, "..", "aa", "f"), (105, make("vwxyz", 9000), None, "g"), (105, None, None, "h"), (None, known[1][1], None, "i")]
    table = spark.createDataFrame(known + odd, "doc_id long, text string, lang string, n string")
    kept = {(x.doc_id, x.n): x.lang for x in langid.with_language(table, langid.learn(table.where("doc_id < 100"))).collect()}
    assert {k: v for k, v in kept.items() if k[0] is None or k[0] >= 100} == {(100, "b"): "aa", (103, "e"): kept[103, "e"], (105, "g"): "vv", (None, "i"): "aa"}
    assert len(kept) == 64
    assert langid.with_language(table.limit(0), langid.learn(table)).count() == 0


def out_of_place(text, profile, most):
    """The distance and the greatest possible one, from counts of all n-grams."""
    def counted(texts):
        c = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
                line = f"_{w}_"
                c.update(line[a : a + n] for n in (1, 2, 3) for a in range(len(line) - n + 1) if line[a : a + n] != "_")
        # ties go to the smaller code; a border is smaller than all letters
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], functools.reduce(lambda a, b: a << 21 | (1 if b == "_" else ord(b)), x[0], 0)))][:most]
    top, own = counted([text]), {g: i for i, g in enumerate(counted(profile))}
    return sum(min(abs(own[g] - i), most) if g in own else most for i, g in enumerate(top)), most * len(top)


def test_language_equals_distances_by_hand(spark):
    r = random.Random(8)
    say = {a: (lambda n, v=["".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(60)]: " ".join(r.choice(v) for _ in range(n))) for a in ("abcdefgh", "efghijkl", "cdefijé")}
    learned = [(i, say[a](r.randint(1, 50)), a) for i, a in enumerate(list(say) * 12)]
    tests = [(500 + i, say[a](r.randint(1, 80)), None) for i, a in enumerate(list(say) * 8)] + [(600, learned[0][1], None), (600, learned[0][1], None), (601, "Ab. AB, ab", None), (602, say["abcdefgh"](20_000), None)]
    table = spark.createDataFrame([(*x, "l") for x in learned + tests], "doc_id long, text string, lang string, lang_pred string")
    got = sorted((x.doc_id, x.lang_pred, x.score) for x in langid.identify(table.where("doc_id >= 500"), langid.learn(table)).collect())
    want = []
    for i, t, _ in tests:
        found = {a: out_of_place(t, [x for _, x, b in learned if a == b], langid.PROFILE) for a in sorted(say)}
        best = min(sorted(say), key=lambda a: found[a][0])
        want.append((i, best, pytest.approx(1 - found[best][0] / found[best][1])))
    assert got == sorted(want, key=lambda x: x[0])


def lm_by_hand(rows, train, order):
    """doc_id, n_tokens, n_known, train tokens, base score and model score."""
    own = [(i, [*words(t), "</s>"]) for i, t in rows]
    c = Counter(w for i, t in own if train(i) for w in t)
    n, v = sum(c.values()), len(c)
    grams = Counter(tuple(["<s>", *t][a : b + 1]) for i, t in own if train(i) for b in range(1, len(t) + 1) for a in range(max(0, b - order + 1), b))
    seen = Counter()
    for g, m in grams.items():
        seen[g[:-1]] += m

    def p(context, w):
        if not context:
            return (c[w] + 1) / (n + v + 1)
        return (grams[*context, w] + lm.PRIOR * p(context[1:], w)) / (seen[context] + lm.PRIOR)

    out = []
    for i, t in own:
        line = ["<s>", *t]
        model = sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        out.append((i, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), model))
    return out


@pytest.mark.parametrize(("block_tokens", "order"), [(1 << 20, 3), (5, 3), (0, 2), (700, 4), (700, 1)])
def test_lm_equals_a_model_by_hand(spark, block_tokens, order):
    docs, rows = frame(spark)
    train = lambda i: i is not None and i % 7 != 2
    got = lm.score(docs, F.col("doc_id") % 7 != 2, block_tokens=block_tokens, order=order).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for x, y in zip(sorted(lm_by_hand(rows, train, order), key=key), sorted([tuple(r) for r in got], key=key), strict=True):
        assert x[:4] == y[:4]
        assert y[4] == pytest.approx(x[4], rel=1e-9)
        assert y[5] == pytest.approx(x[5], abs=x[1] * order / lm.STEP)
    assert listed(lm.score(docs.limit(0), F.lit(True))) == []
    assert {r.score for r in lm.score(docs, F.lit(False), order=order).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_elias_fano_finds_what_is_there(n):
    r = np.random.default_rng(n)
    values = np.unique(r.integers(0, 1 << 40, n).astype(np.uint64))
    x = lm.EliasFano(values)
    x.open()
    whole = lambda k: (np.zeros(k, np.int64), np.full(k, len(values)))
    assert (x.find(values, *whole(len(values))) == np.arange(len(values))).all()
    other = r.integers(0, 1 << 41, 1000).astype(np.uint64)
    assert ((x.find(other, *whole(1000)) >= 0) == np.isin(other, values)).all()
    left = np.arange(len(values)) // 2
    assert (x.find(values, left, np.arange(len(values))) == -1).all()  # outside the range
    assert (x.at(np.arange(len(values))) == values).all()


def simhash_by_hand(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[k : k + 3]) for k in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components(spark):
    docs, rows = frame(spark)
    fps = [simhash_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, fps[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert listed(simhash.near_duplicates(frame(spark, [])[0])) == []


@pytest.mark.parametrize("kind", ["chains", "cluster"])
def test_links_join_what_is_two_bits_apart(spark, kind):
    r = random.Random(9)
    if kind == "chains":
        fps = set()
        for _ in range(12):
            x = r.getrandbits(64)
            for _ in range(8):
                fps.add(x)
                x ^= 1 << r.randrange(64) | (1 << r.randrange(64) if r.random() < 0.5 else 0)
    else:  # one posting list with many members
        base = r.getrandbits(64)
        fps = {base & ~0xFFFF | r.getrandbits(16) for _ in range(900)}
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                root[find(x)] = find(y)
    if kind == "cluster":  # lists longer than a batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    edges = simhash.settled(simhash.links(table))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {r.node % (1 << 64): r.label for r in simhash.components(edges).collect()}
    ours, theirs = {}, {}
    for x in fps:
        ours.setdefault(found.get(x, ("alone", x)), set()).add(x)
        theirs.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    assert edges.count() <= 56 * simhash.SHORT * len(fps)


def test_long_lists_send_no_pairs(spark):
    fps = spark.range(0, 4000).selectExpr("id * 17 % 65536 as fp").distinct()
    assert simhash.posted(fps, simhash.MASKS).mapInArrow(simhash.tallied, "a long, b long, set int").count() <= 56 * simhash.SHORT * 4000
    assert simhash.LEAST_LISTS == 6 and len(simhash.KEYS) == 56


def test_shards(spark):
    docs, rows = frame(spark)
    got = sharding.shard(docs, 4).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == sorted(
        (i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    of_text, slots, sums = {}, {}, Counter()
    for r in got:
        of_text.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sums[r.shard] += r["size"]
    assert all(len(x) == 1 for x in of_text.values())
    assert set(slots) <= set(range(4)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    assert sorted(sums.values()) == sorted(shard_sums(sorted(groups.values(), reverse=True), 4))
    assert listed(sharding.shard(frame(spark, [])[0], 4)) == []


def shard_sums(sizes, shards):
    """The bytes of each shard by the plan, item by item; every item is in one shard."""
    counts = sorted(Counter(sizes).items(), reverse=True)
    plan, sums, seen = sharding.into_shards(counts, shards), Counter(), Counter()
    for size, a, b, k in plan:
        sums[k] += size * (b - a)
        seen.update((size, i) for i in range(a, b))
    assert seen == Counter((s, i) for s, n in counts for i in range(n)) and set(sums) <= set(range(shards))
    return list(sums.values())


def test_best_fit_decreasing_by_hand():
    one_by_one = lambda sizes: sharding.best_fit_decreasing([(s, 1) for s in sizes], 10)[0]
    assert [b for *_, b in one_by_one([7, 5, 4, 3, 1])] == [0, 1, 1, 0, 1]
    assert sharding.best_fit_decreasing([(4, 5), (2, 3)], 10) == ([(4, 0, 2, 0), (4, 2, 4, 1), (4, 4, 5, 2), (2, 0, 1, 0), (2, 1, 2, 1), (2, 2, 3, 2)], 3)
    r = random.Random(1)
    for _ in range(20):  # runs are what items by themselves would do
        sizes, room = sorted((r.randint(1, 12) for _ in range(60)), reverse=True), r.randint(5, 40)
        gaps = {}
        for s in sizes:
            fit = [(g, b) for b, g in gaps.items() if g >= s]
            b = min(fit)[1] if fit else len(gaps)
            gaps[b] = gaps.get(b, room) - s
        assert sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), room)[1] == len(gaps)
    sums = shard_sums(sorted((r.randint(1, 1000) for _ in range(3000)), reverse=True), 24)
    assert max(sums) - min(sums) < 0.001 * max(sums)
    assert len(shard_sums([1000, *[1] * 500], 4)) == 4 and sorted(shard_sums([50, 50, 50, *[1] * 30], 4)) == [30, 50, 50, 50]
    assert sorted(shard_sums([10] * 7, 4)) == [10, 20, 20, 20]
    assert sharding.into_shards([], 4) == []


def dedup_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, []
    for i, t in order:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 49):
            first = seen.get(b[k : k + 50])
            if first is not None and first != (i if i is not None else math.inf):
                gone |= set(range(k, k + 50))
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i if i is not None else math.inf)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((i, len(b), sum(k in gone and k - 1 not in gone for k in gone), kept))
    return out


@pytest.mark.parametrize("heavy", [1 << 15, 1])
def test_suffix_dedup(spark, heavy):
    line = "This line of about eighty bytes is the same, é and all, in a number of documents. "
    own = [f"{line * (i % 4)}{i} other words {i * i} {line[: 40 + i]}" for i in range(25)] + ["ab" * 200, "xx" + "ab" * 100, line[:50], line[:49]]
    docs, rows = frame(spark, list(enumerate(texts() + own)))
    got = [(r.doc_id, r.n_bytes, len(r.removed) // 2, bytes(r.kept)) for r in suffix.dedup(docs, block_bytes=2000, heavy=heavy).collect()]
    assert sorted(got, key=repr) == sorted(dedup_by_hand(rows), key=repr)
    assert listed(suffix.dedup(frame(spark, [])[0])) == []


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(30))
    bad = lambda: " ".join("".join(r.choice("abcde") for _ in range(4)) + "&&&" for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "z" * 100_000), (None, bad())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 204
    assert sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(150, 200)) >= 48
    assert {x.score for x in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert listed(quality.score(docs.limit(0), model)) == []


def test_quality_word_vectors_cover_all_documents(spark):
    texts = ["alpha beta gamma", "delta epsilon zeta eta", None, "theta beta alpha &&& x", "delta delta DELTA"] * 3
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    index, sums = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for t in texts:
        own = quality.tokens(pa.array([t or ""]))[0]
        for i in range(len(own)):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                sums[own[i]] += index[own[j]] * (i != j)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    want = np.where(size > 0, sums / np.maximum(size, 1e-9), 0) + 0.5 * index / quality.NONZERO**0.5
    labels = spark.createDataFrame([(3, 1), (5, 0), (8, 1)], "doc_id long, quality int")
    for n in (20_000, 1):  # the sample is for the network alone
        assert np.allclose(quality.fit(docs, labels, sample_rows=n).vectors, want, atol=1e-6)
