"""Each operator against brute force, and its edge cases."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from groundspan.llm import bpe, common, decontam, lines, lm, repetition, secrets, simhash, suffix, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, odd bytes."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    base = " ".join(words(rng, 120))
    return [(1, base), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, base), (6, base), (None, base), (7, "é" * 500), (8, "\x00� 日本語  "), (9, "one")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    clash = [(i, t, i, "x", 1.5, 2, 3, b"b") for i, t in odd_rows]
    return spark.createDataFrame(clash, "doc_id long, text string, row long, keep string, key double, n int, rep int, anchors binary")


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# 1


def brute_repetition(text):
    ws = [w for w in re.split(r"[ \t\n\r\f\v]+", text or "") if w]
    total, out = sum(map(len, ws)), {}
    for n in repetition.NGRAM_LIMITS:
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        count = Counter(grams)
        inside = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + n)}
        out[f"dup_{n}gram_char_frac"] = sum(len(ws[k]) for k in inside) / total if total else 0.0
    ls = [x for x in (line.strip(" \t\r\f\v") for line in (text or "").split("\n")) if x]
    count = Counter(ls)
    dup = [x for x in ls if count[x] > 1]
    return out | {"dup_line_frac": len(dup) / len(ls) if ls else 0.0, "dup_line_char_frac": sum(map(len, dup)) / sum(map(len, ls)) if ls else 0.0, "n_words": len(ws), "n_lines": len(ls)}


def test_repetition_equals_brute_force(spark, odd, none):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(200), 6)).replace(" w1 ", "\n") for _ in range(40)] + ["a b c\na b c\n x", "é é\né é"]
    rows = {r.doc_id: r for r in repetition.repetition(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        for k, v in brute_repetition(text).items():
            assert rows[i][k] == pytest.approx(v), (i, k)
    assert repetition.repetition(none).count() == 0
    got = repetition.repetition(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.n_words == 0} == {2, 3, 4} and not any(r.keep for r in got if r.n_words == 0)
    assert all(r.keep for r in got if r.doc_id in (1, 5, 6, 7, 9))


# 2


def brute_passages(rows, length):
    windows, count, first = {}, Counter(), {}
    for k, (i, text) in enumerate(rows):
        ws = [w for w in re.split(r"[ \t\n\r\f\v]+", text or "") if w]
        for a in range(len(ws) - length + 1):
            g = tuple(ws[a : a + length])
            windows[k, a] = (i, g)
            count[g] += 1
            first[g] = min(first.get(g, (i, a)), (i, a))
    found = defaultdict(set)
    for (k, a), (i, g) in windows.items():
        if count[g] > 1:
            found[i, "repeat"] |= set(range(a, a + length))
            if first[g] != (i, a):
                found[i, "remove"] |= set(range(a, a + length))
    return found


def test_passages_equal_brute_force(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(suffix, "COLLECTION", 2000)  # several collections
    rng = random.Random(2)
    shared = [words(rng, n) for n in (49, 50, 51, 90, 200)]
    rows = []
    for i in range(40):
        ws = words(rng, rng.randrange(120))
        for p in rng.sample(shared, rng.randrange(3)):
            k = rng.randrange(len(ws) + 1)
            ws[k:k] = p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
    rows += [(40, "same " * 300), (41, "ab cd " * 120), (42, rows[3][1]), (43, rows[3][1])]
    for table, content in ((frame(spark, rows), rows), (odd, [r for r in odd_rows if r[0] is not None])):
        got = defaultdict(set)
        for r in suffix.repeated_passages(table).collect():
            assert not got[r.doc_id, r.kind] & set(range(r.start_word - 1, r.end_word + 1)), "stretches are apart"
            got[r.doc_id, r.kind] |= set(range(r.start_word, r.end_word))
        assert dict(got) == {k: v for k, v in brute_passages(content, suffix.LENGTH).items() if v}
    assert suffix.repeated_passages(none).count() == 0


def test_columns_are_those_of_sorted_suffixes(tmp_path):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 25)
    ends = np.cumsum(sizes)
    symbols = rng.integers(1, 4, ends[-1])
    block, suffix.BLOCK = suffix.BLOCK, 64  # many blocks
    try:
        files = suffix.Files(f"file://{tmp_path}/x")
        suffix.construct(symbols, ends, sizes, files, cap=10)
        lcp, bwt = (np.concatenate(list(files.read(k))) for k in ("lcp", "bwt"))
        files.drop()
    finally:
        suffix.BLOCK = block
    texts = [tuple(symbols[e - s : e]) for e, s in zip(ends, sizes)]
    want = sorted((t[k:], i, t[k - 1] if k else 0) for i, t in enumerate(texts) for k in range(len(t) + 1))
    assert sorted(zip([w[0] for w in want], bwt)) == sorted((w[0], w[2]) for w in want)
    common_prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp[1:].tolist() == [min(10, common_prefix(a[0], b[0])) for a, b in zip(want, want[1:])]


# 3


def edit(rng, text, k):
    t = list(text)
    for _ in range(k):
        p, way = rng.randrange(len(t)), rng.random()
        if way < 0.34:
            t[p] = rng.choice("etaoin")
        elif way < 0.67:
            t.insert(p, rng.choice("etaoin "))
        else:
            del t[p]
    return "".join(t)


def levenshtein(a, text):
    row = list(range(len(a) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, d in enumerate(a, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_recall(spark, odd, none):
    rng = random.Random(4)
    syllables = ["tion", "er", "an", "the", "re", "on", "st", "é", "ou"]
    sentence = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    items = [(i, sentence(rng.randrange(15, 50))) for i in range(20)] + [(20, "short one"), (21, None), (22, ""), (19, "another text of that item, which is long enough for all")]
    planted, rows = [], []
    for d in range(150):
        i, text = items[rng.randrange(20)]
        k = int(len(text) * rng.choice([0, 0.03, 0.06, 0.09]))
        rows.append((d, f"{sentence(40)} {edit(rng, text, k).upper() if d % 3 else edit(rng, text, k)}\n\n{sentence(30)}"))
        planted.append((d, i))
    rows += [(d, sentence(80)) for d in range(150, 220)] + [(220, "This is a Short  one."), (221, None), (222, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    normal = lambda t: decontam.normal(t).decode()
    brute = {}
    for d, text in rows:
        for i, item in items[:21]:
            if text and decontam.edit_distance(decontam.normal(item), decontam.normal(text)) <= decontam.edits(len(normal(item))):
                brute[d, i] = 1
    assert set(got) <= set(brute), "whatever is found is verified"
    assert len(set(got) & set(brute)) >= 0.95 * len(brute) and (220, 20) in got
    for d, i in planted[:10]:
        assert decontam.edit_distance(decontam.normal(items[i][1]), decontam.normal(rows[d][1])) == levenshtein(normal(items[i][1]), normal(rows[d][1]))
    kept = {r.doc_id for r in decontam.drop_contaminated(frame(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_texts_without_spaces(spark):
    rng = random.Random(14)
    kinds = ([chr(0x4E00 + k) for k in range(600)], [chr(0x0E01 + k) for k in range(40)], list("abcdefghijklmnopqrstuvwxyz_.(){};="))
    line = lambda kind, n: "".join(rng.choices(kind, k=n))
    items = [(i, line(kinds[i % 3], rng.randrange(60, 160))) for i in range(18)]
    copies = [(100 * k + i, line(kinds[i % 3], rng.randrange(150, 300)) + text + line(kinds[i % 3], 200)) for k in range(2) for i, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontam.contaminated(frame(spark, copies + [(900 + k, line(kind, 500)) for k, kind in enumerate(kinds)]), bench).collect()}
    assert got == {(d, d % 100): 0 for d, _ in copies}


@pytest.mark.parametrize("spaced", [True, False])
def test_decontamination_finds_copies_with_all_edits_allowed(spark, spaced):
    rng = random.Random(15)
    letters = "etaoinshrdlu    " if spaced else [chr(0x4E00 + k) for k in range(600)]
    line = lambda n: "".join(rng.choices(letters, k=n))
    items = [(i, decontam.normal(line(rng.randrange(60, 200))).decode()) for i in range(30)]
    rows = []
    for d in range(300):
        text = items[d % 30][1]
        rows.append((d, line(150) + edit(rng, text, decontam.edits(len(text))) + line(150)))
    brute = {(d, d % 30) for d, text in rows if decontam.edit_distance(items[d % 30][1].encode(), decontam.normal(text)) <= decontam.edits(len(items[d % 30][1]))}
    clash = frame(spark, rows).selectExpr("*", "1 AS gone", "2 AS __gone", "3 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(clash, bench).collect()}
    assert len(brute) > 200 and len(got & brute) >= 0.9 * len(brute)
    left = decontam.drop_contaminated(clash, bench)
    assert left.columns == clash.columns and {r.doc_id for r in left.collect()} == set(range(300)) - {d for d, _ in got}


def test_a_very_long_item_costs_its_own_memory():
    rng = random.Random(16)
    rows = [(i, "".join(rng.choices("etaoinshrdlu ", k=100)).encode()) for i in range(50)] + [(99, "".join(rng.choices("etaoinshrdlu ", k=100_000)).encode())]
    tracemalloc.start()
    items = decontam.Items(rows, 4)
    texts = [b"here: " + edit(rng, rows[-1][1].decode(), 40).encode() + b" there", b"there: " + rows[3][1]]
    got = items.matches(texts, decontam.candidates(items, texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {(0, 50), (1, 3)} and most < 1e9


def test_random_walks_follow_edits():
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=200))
    items, far, near = (decontam.Items([(0, t.encode()[:200].ljust(200))], 4).hashes[0] for t in (text, "".join(rng.choices("abcdefgh ", k=200)), edit(rng, text, 6)))
    assert (items == near).mean() > 5 * (items == far).mean()


# 4


def test_bpe_equals_merges_and_round_trips(spark, odd, none):
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.encoder()
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghinorstu \n'é日😀0123<|>", k=rng.randrange(1, 80))) for _ in range(500)] + ["a" * 5000, "<|endoftext|>", "\r\n \t x"]
    rows = {r.doc_id: r for r in bpe.encode(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert rows[i].token_ids == public.encode_ordinary(text) and rows[i].round_trip and rows[i].n_tokens == len(rows[i].token_ids)
    for piece in texts[:200]:
        assert own.decode(np.array(own.encode(piece))).tobytes().decode() == piece
    back = bpe.decode(bpe.encode(frame(spark, list(enumerate(texts)))).drop("text")).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0
    got = bpe.encode(odd).collect()
    assert len(got) == odd.count() and all(r.token_ids is None for r in got if r.text is None) and all(r.round_trip for r in got if r.text is not None)


# 5


def brute_lines(rows):
    count, first = Counter(), {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if i is not None and text is not None else []):
            bare = line.strip(lines.BLANK)
            if len(bare) >= lines.MIN_CHARS:
                count[bare] += 1
                first[bare] = min(first.get(bare, (i, k)), (i, k))
    out = []
    for i, text in rows:
        kept = text
        if text is not None and i is not None:
            gone = lambda k, x: count[x.strip(lines.BLANK)] > lines.MAX_COUNT and first[x.strip(lines.BLANK)] != (i, k)
            kept = "\n".join(x for k, x in enumerate(text.split("\n")) if not gone(k, x))
        out.append((i, kept))
    return out


def line_rows():
    rng = random.Random(7)
    pool = [" ".join(words(rng, 8)) for _ in range(60)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool if rng.random() < 0.8 else [" ".join(words(rng, 9))]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (500, None), (501, "")]


@pytest.mark.parametrize("limits", [(lines.MAX_COUNT, lines.MIN_CHARS), (1, 5)])
def test_lines_equal_brute_force(spark, odd, none, monkeypatch, limits):
    monkeypatch.setattr(lines, "SHARD_BYTES", 4000)  # several shards
    monkeypatch.setattr(lines, "GATHER", 10)
    rows = line_rows()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    monkeypatch.setattr(lines, "MAX_COUNT", limits[0])
    monkeypatch.setattr(lines, "MIN_CHARS", limits[1])
    want = sorted(brute_lines(rows), key=key)
    got = lines.dedup_lines(frame(spark, rows).repartition(4), *limits).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == want
    assert all(r.n_lines - r.n_removed == (r.text or "").count("\n") + 1 or r.text in (None, "") for r in got)
    assert lines.dedup_lines(odd).count() == odd.count() and lines.dedup_lines(none).count() == 0
    clash = frame(spark, rows).selectExpr("*", *(f"{k} AS __{c}" for k, c in enumerate(("bucket", "keys", "prints", "gone", "n", "removed", "text", "left"))), "9 AS `a.b`")
    kept = lines.drop_repeated_lines(clash, *limits)
    assert kept.columns == clash.columns and kept.select(*clash.columns[5:-1]).distinct().collect() == [tuple(range(8))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == want, "every row stays"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert lines.drop_repeated_lines(none).count() == 0


def test_a_shard_tells_lines_from_others_with_the_same_key():
    keys, prints = np.array([5, 5, 9, 9], np.uint64), np.array([2, 1, 7, 7], np.uint32)
    shard = lines.Shard(keys, prints, np.array([9, 3, 4, 4]), np.array([1, 2, 8, 6]), np.array([0, 0, 3, 2], np.int32))
    at, place = shard.often(np.array([5, 5, 9, 77], np.uint64), np.array([2, 1, 7, 7], np.uint32), 2)
    assert at.tolist() == [1, 2] and shard.counts[place].tolist() == [3, 8] and shard.owners[place].tolist() == [2, 6] and shard.places[place].tolist() == [0, 2]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    hashed = lines.build(keys)
    assert sorted(lines.index_of(keys, *hashed).tolist()) == list(range(len(keys)))
    assert len(lines.index_of(keys, *lines.build(keys[:0]))) == len(keys)


# 6


def near_copies(rng, n=60):
    rows, i = [], 0
    for _ in range(n):
        ws = words(rng, rng.randrange(60, 300), 3000)
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = [f"x{rng.randrange(999)}" if rng.random() < 0.03 else w for w in ws]
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


def test_simhash_recall_against_all_pairs(spark, odd, none):
    rows = near_copies(random.Random(9)) + [(900, None), (901, ""), (902, "- -"), (903, "Word"), (904, "word")]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    texts, prints = simhash.fingerprints(*common.text_bytes(pa.array([t for _, t in rows])))
    ids = [rows[t][0] for t in texts]
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    i, j = np.nonzero(np.triu(far <= simhash.MAX_DISTANCE, 1))
    root = simhash.local_roots(i, j, np.arange(len(ids)))
    hit = [(ids[a] in got and ids[b] in got and got[ids[a]].group_id == got[ids[b]].group_id) for a, b in zip(i, j)]
    assert len(hit) > 50 and np.mean(hit) >= 0.9
    alone = {ids[k] for k in range(len(ids)) if (root == root[k]).sum() == 1}
    assert not alone & set(got)
    assert got[904].group_id == 903 and not {900, 901, 902} & set(got)
    for r in got.values():
        assert r.keep == (r.doc_id == r.group_id)
    left = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert len({r.doc_id for r in left}) == len(rows) - sum(not r.keep for r in got.values())
    assert {r.doc_id for r in simhash.near_duplicates(odd).collect()} == {1, 6} and simhash.near_duplicates(none).count() == 0
    clash = frame(spark, rows[:4] + [(950, rows[0][1])]).selectExpr("*", "doc_id AS gone", "doc_id AS Gone_", "1 AS gone_id", "2 AS hi", "3 AS rep")
    assert simhash.drop_near_duplicates(clash).columns == clash.columns and 950 not in {r.doc_id for r in simhash.drop_near_duplicates(clash).collect()}
    assert simhash.drop_near_duplicates(none).count() == 0


def test_trie_join_finds_all_pairs_of_a_bucket():
    rng = np.random.default_rng(2)
    hi = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    lo = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(100, 300):  # copies with a few bits changed
        hi[k], lo[k] = hi[k % 100] ^ np.uint64(1 << int(rng.integers(60))), lo[k % 100] ^ np.uint64(1 << int(rng.integers(60)))
    key, code = (hi >> np.uint64(52)).astype(np.int64), hi
    order = np.lexsort((code, key))
    key, code, hi, lo = key[order], code[order], hi[order], lo[order]
    found = {(min(a, b), max(a, b)) for i, j in simhash.trie_pairs(key, code, hi, lo, 12) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if key[a] == key[b] and int(hi[a] ^ hi[b]).bit_count() + int(lo[a] ^ lo[b]).bit_count() <= simhash.MAX_DISTANCE}
    assert found == want and want


def far_pairs(rng, n, distance, kept=0):
    """n pairs of fingerprints that differ in so many bits, none of them among the first kept ones."""
    bits = rng.integers(0, 2, (n, 128), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[kept + rng.permutation(128 - kept)[:distance]] ^= 1
    return [np.packbits(b, axis=1).view(">u8").astype(np.uint64) for b in (bits, other)]


@pytest.mark.parametrize("distinct", [1000, 10**8])
def test_simhash_tables_reach_the_stated_recall(distinct):
    exact = simhash.exact_bits(distinct)
    a, b = far_pairs(np.random.default_rng(4), 3000, simhash.MAX_DISTANCE)
    met = np.zeros(3000, bool)
    for order in simhash.orders(simhash.tables(exact)):
        met |= simhash.codes(*a.T, order) >> np.uint64(64 - exact) == simhash.codes(*b.T, order) >> np.uint64(64 - exact)
    assert met.mean() >= simhash.RECALL - 0.015


@pytest.mark.parametrize("size", [40, 2000, 100_000])
def test_a_bucket_of_any_size_loses_no_pair(size):
    rng = np.random.default_rng(6)
    a, b = far_pairs(rng, min(size, 400) // 2, simhash.MAX_DISTANCE, 12)
    rest = rng.integers(0, 1 << 63, (size - 2 * len(a), 2), dtype=np.uint64)
    prints = np.concatenate([a, b, rest])
    own = np.arange(len(prints))
    prints[:, 0] &= np.uint64((1 << 52) - 1)  # all in one bucket
    order = np.argsort(prints[:, 0], kind="stable")
    hi, lo = prints[order].T.copy()
    found = {tuple(sorted((own[order[x]], own[order[y]]))) for i, j in simhash.trie_pairs(np.zeros(size, np.int64), hi, hi, lo, 12) for x, y in zip(i.tolist(), j.tolist())}
    assert {(k, k + len(a)) for k in range(len(a))} <= found


def test_simhash_joins_the_pairs_of_many_buckets_at_once(monkeypatch):
    """A pass over all labels for each block of pairs made the time grow faster than the corpus; buckets of all widths, one of them with many copies."""
    rng = np.random.default_rng(8)
    a, b = far_pairs(rng, 1200, 9)
    close = a[0] ^ (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64))
    prints = np.concatenate([a, b, close])
    hi, lo = prints.T.copy()
    rows = [(np.uint64(k << 6) | simhash.codes(hi, lo, order) >> np.uint64(58)).astype(np.int64) for k, order in enumerate(simhash.orders(4))]
    key, rep = np.concatenate(rows), np.tile(np.arange(len(prints)), 4)
    batch = pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[rep].view(np.int64)) for x in (hi, lo)), pa.array(rep)], ["key", "hi", "lo", "rep"])
    calls, join = [], simhash.local_roots
    monkeypatch.setattr(simhash, "local_roots", lambda *x: calls.append(len(x[0])) or join(*x))
    (out,) = simhash._stars(6, 4)(iter([batch]))
    met = np.any([own[:, None] == own[None] for own in rows], axis=0)
    i, j = np.nonzero(np.triu(met & (np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= simhash.MAX_DISTANCE), 1))
    root = join(i, j, np.arange(len(prints)))
    want = {(k, r) for k, r in enumerate(root.tolist()) if k != r}
    assert set(zip(out.column("u").to_pylist(), out.column("v").to_pylist())) == want and len(want) > 1000
    assert len(calls) <= 2


@pytest.mark.parametrize("distinct", [300_000, 2_800_000, 10**9])
def test_simhash_parts_of_buckets_reach_the_stated_recall(distinct):
    exact, inner = simhash.exact_bits(distinct), simhash.inner_bits(distinct)
    a, b = far_pairs(np.random.default_rng(5), 3000, simhash.MAX_DISTANCE)
    found = np.zeros(3000, bool)
    for table, order in enumerate(simhash.orders(simhash.tables(exact, inner=inner))):
        met = np.flatnonzero(simhash.codes(*a.T, order[:exact]) == simhash.codes(*b.T, order[:exact]))
        for split in range(simhash.splits(exact, inner)):
            parts = simhash.split_order(order[:exact], table, split)[:inner]
            assert not set(parts) & set(order[:exact])
            found[met] |= simhash.codes(*a[met].T, parts) == simhash.codes(*b[met].T, parts)
    assert inner and found.mean() >= simhash.RECALL - 0.015


def test_simhash_compares_few_of_a_bucket_of_many(monkeypatch):
    """At 6 GB all pairs of entries of a bucket were compared, and 52 rows of each fingerprint sent."""
    distinct = 2_800_000
    exact, inner = simhash.exact_bits(distinct), simhash.inner_bits(distinct)
    rng = np.random.default_rng(9)
    a, b = far_pairs(rng, 2000, simhash.MAX_DISTANCE)
    copies = a[0] ^ (np.uint64(1) << rng.integers(0, 64, (2000, 2), dtype=np.uint64))  # so many that a trie goes down
    prints = np.concatenate([a, b, copies, rng.integers(0, 1 << 63, (distinct >> exact, 2), dtype=np.uint64) << np.uint64(1)])
    for bit in simhash.orders(1)[0][:exact].tolist():  # all in one bucket
        prints[:, bit // 64] &= ~(np.uint64(1) << np.uint64(bit % 64 ^ 7))
    rep = np.arange(len(prints))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int64)), *(pa.array(x.copy().view(np.int64)) for x in prints.T), pa.array(rep)], ["key", "hi", "lo", "rep"])
    compared, compare = [], simhash._compare
    monkeypatch.setattr(simhash, "_compare", lambda a0, a1, b0, b1, *rest: compared.append(int(((a1 - a0) * (b1 - b0)).sum())) or compare(a0, a1, b0, b1, *rest))
    (out,) = simhash._stars(exact, simhash.tables(exact, inner=inner), inner)(iter([batch]))
    root = dict(zip(out.column("u").to_pylist(), out.column("v").to_pylist()))
    assert np.mean([root.get(2000 + k) == root.get(k, k) for k in range(2000)]) >= simhash.SHARE - 0.05
    assert len({root.get(k, k) for k in range(4000, 6000)}) == 1
    for k, v in root.items():
        assert v < k
    assert sum(compared) < len(prints) ** 2 / 5 and simhash.tables(exact, inner=inner) < 26


def test_fingerprints_of_texts_of_any_length():
    rng = random.Random(3)
    texts = ["", "one", "one two", *(" ".join(words(rng, n, 40)) for n in (3, 255, 256, 257, 511, 5000, 2, 70_000)), None]
    where, prints = simhash.fingerprints(*common.text_bytes(pa.array(texts)))
    assert where.tolist() == [k for k, t in enumerate(texts) if t]
    for k, got in zip(where, prints):
        one = simhash.fingerprints(*common.text_bytes(pa.array([texts[k]])))[1][0]
        assert (one == got).all()
    hashes = np.random.default_rng(1).integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    count = np.array([1, 254, 255, 256, 2, 510, 511, 1211])
    first = np.cumsum(count) - count
    bits = np.unpackbits(hashes.view(np.uint8), axis=1)
    assert (simhash.bit_sums(hashes, first, count) == [bits[f : f + n].sum(0) for f, n in zip(first, count)]).all()


def test_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(50, 60), (60, 70), (45, 70), (80, 80)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {50: 45, 60: 45, 70: 45}


# 7


def brute_guesses(value, found):
    best = {0: 0.0}
    for j in range(1, len(value) + 1):  # every segmentation, a brute-force span being of any length
        best[j] = min(
            [best[i] + (0.3 if i else 0) + (j - i) for i in range(j)] + [best[i] + (0.3 if i else 0) + c for i, k, c in found if k == j]
        )
    return best[len(value)]


def test_guesses_are_least_over_segmentations():
    ranked = secrets.words()
    longest = max(map(len, ranked))
    rng = random.Random(3)
    for _ in range(60):
        value = "".join(rng.choice(["pass", "2019", "aaa", "qwert", "x7", "K", "abc", "321", "$", "secret"]) for _ in range(rng.randrange(1, 6)))
        found = list(secrets.parts(value, ranked, longest))
        assert secrets.guesses(value, ranked, longest) == pytest.approx(brute_guesses(value, found)), value
    cost = lambda v: secrets.guesses(v, ranked, longest)
    assert cost("password") < 2 and cost("P@ssword1") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("2019-03-04") < 5
    assert cost("9f8aQz71kLm3Xw0") > secrets.THRESHOLD and cost("z" * 100_000) < 10
    for size in (30, 40, 300):
        unit = "".join(rng.choices("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ", k=size))
        assert cost(unit * 2) == pytest.approx(cost(unit) + np.log10(2)), "a unit of any size"


def test_parts_are_those_of_plain_loops():
    """Words, dates, repeats, sequences and keyboard walks, each found by looking at every stretch."""
    rng = random.Random(31)
    ranked = {"pass": 3, "word": 9, "password": 1, "secret": 2, "apple": 70}
    rows = ["1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
    at = {c: (r, k + (r > 0)) for r, row in enumerate(rows) for k, c in enumerate(row)} | {"`": (0, -1)}
    at = {c: (r, k + 1 if r == 0 else k) for c, (r, k) in at.items()}
    near = lambda a, b: a in at and b in at and (at[b][0] - at[a][0], at[b][1] - at[a][1]) in {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
    leet = str.maketrans("4@8310!$57", "aabeloisst")
    for _ in range(200):
        value = "".join(rng.choice(["pass", "Word", "p4ss", "2019", "-03-", "04", "aaa", "qwe", "asd", "x7", "K", "bcd", "321", "secret", "zxcv"]) for _ in range(rng.randrange(1, 6)))
        n, low = len(value), value.lower()
        stretches = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        found = {(i, j) for i, j, _ in secrets.parts(value, ranked, 8)}
        own = {(i, j) for i, j in stretches if j - i >= 3 and (low[i:j] in ranked or low[i:j].translate(leet) in ranked)}
        assert own <= found, value
        steps = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
        runs = {(i, j) for i, j in stretches if j - i >= 3 and value[i:j].isalnum() and len(set(steps[i : j - 1])) == 1 and steps[i] in (1, -1)}
        assert {(i, j) for i, j in runs if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in runs)} <= found, value
        moves = [near(a, b) for a, b in zip(low, low[1:])]
        long = {(i, j) for i, j in stretches if j - i >= 4 and all(moves[i : j - 1])}
        assert {(i, j) for i, j in long if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in long)} <= found, value
        repeated = {(i, j) for i, j in stretches for size in range(1, (j - i) // 2 + 1) if (j - i) % size == 0 and j - i >= 3 and value[i:j] == value[i : i + size] * ((j - i) // size)}
        got = secrets.repeats(value)
        assert {(a, b) for a, b, _ in got} <= repeated and all(any(a <= i and j < b + size for a, b, size in got) for i, j in repeated), value
        dates = {(i, j) for i, j in stretches if re.fullmatch(r"(19|20)\d\d(-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]))?", value[i:j])}
        assert {i for i, _ in dates} <= {i for i, _ in found}, value


def test_secret_scan(spark, odd, none):
    rows = [(1, 'x api_key = "9f8aQz71kLm3Xw0pT" y'), (2, "password: changeme"), (3, "the token of it is here"), (4, "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfi"), (5, None), (6, ""), (7, "tokens: many")]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 4} and got[1].is_secret and got[4].is_secret and not got[2].is_secret
    assert rows[0][1][got[1].value_start : got[1].value_end] == "9f8aQz71kLm3Xw0pT"
    assert secrets.scan(odd).count() == 0 and secrets.scan(none).count() == 0


def test_camel_case_names_are_scanned(spark):
    value = "9f8aQz71kLm3Xw0pT"
    named = ["dbPassword", "userPassword", "clientSecret", "accessToken", "secretKey", "DBPassword", "db2Password", "passwordHash", "myApiKeyValue", "db_password", "apiKey"]
    rows = [(k, form.format(name, value)) for k, (name, form) in enumerate((n, f) for n in named for f in ('{} = "{}"', "{}={}", '{{"{}": "{}"}}'))]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows + [(900, "tokenizer: BertWordPiece77"), (901, "compasstoken: x7Qz81kLm3")])).collect()}
    assert set(got) == {k for k, _ in rows}
    assert all(r.name == named[k // 3] and r.is_secret and rows[k][1][r.value_start : r.value_end].rstrip("}") == value for k, r in got.items())


# 8


def test_url_filter(spark):
    rows, right = urls.labelled(), []
    hosts = sorted(urls._UNWANTED_HOSTS + urls._WANTED_HOSTS)
    for seed in range(3):
        held = set(random.Random(seed).sample(hosts, len(hosts) // 5))
        unseen = lambda u, held=held: any(f"{h}." in urls.parts(u)[0] for h in held)
        weights, bias = urls.fit([r for r in rows if not unseen(r[0])])
        test = [r for r in rows if unseen(r[0])]
        right += ((urls.predict([u for u, _ in test], weights, bias) >= 0.5) == np.array([y for _, y in test])).tolist()
    assert np.mean(right) > 0.8, "on hosts never seen"
    odd = [(1, None), (2, ""), (3, "http://lucky-bets.example.com/claim"), (3, "http://lucky-bets.example.com/claim"), (4, "http://[bad"), (5, "https://village-library.example.org/about"), (6, "http://x.example.com/" + "a" * 100_000)]
    got = urls.filter_urls(spark.createDataFrame(odd, "page_id long, url string").selectExpr("*", "1 AS url_score")).collect()
    assert len(got) == len(odd) and got[0].url_blocked is None and got[2].url_blocked and got[3].url_blocked and not got[5].url_blocked
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # scores by plain loops over the n-grams
    weights, bias = urls.fitted()
    bucket = {}
    for page, score in [(r.url, r.url_score) for r in got if r.url is not None] + list(zip([u for u, _ in rows[:50]], urls.predict([u for u, _ in rows[:50]], weights, bias))):
        host, path = urls.parts(page)
        grams = [(kind, t[i : i + n]) for n in urls.LENGTHS for kind, t in (("host", f"^{host}$" if host else ""), ("path", f"{path}$" if path.strip("/") else "")) for i in range(len(t) - n + 1)]
        _, own = urls.features([page])
        assert len(own) == len(grams)
        for gram, b in zip(sorted(grams, key=lambda g: len(g[1])), own.tolist()):
            assert bucket.setdefault(gram, b) == b, "an n-gram has one bucket"
        assert score == pytest.approx(1 / (1 + np.exp(-(sum(weights[bucket[g]] for g in grams) / np.sqrt(max(1, len(grams))) + bias))))


def test_no_url_of_the_given_pages_was_learned(spark):
    pages = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.url]
    learned = urls.labelled()
    assert not {urls.parts(u) for u in pages} & {urls.parts(u) for u, _ in learned}
    names = {h for u in pages for h in urls.parts(u)[0].split(".")} - {"", "www", "com", "net", "org", "edu", "example"}
    assert not names & {h for u, _ in learned for h in urls.parts(u)[0].split(".")}


# 9


def toxic_texts(rng, n):
    texts, labels = [], []
    for k in range(n):
        ws = words(rng, rng.randrange(20, 150), 500)
        toxic = k % 4 == 0
        for _ in range(max(2, len(ws) // 20) if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(["nasty", "awful", "vile"]) + rng.choice(["", "est", "ness", "ly"])
        texts.append(" ".join(ws))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_on_held_out_texts(spark, odd, none):
    rng = random.Random(11)
    texts, labels = toxic_texts(rng, 400)
    labelled = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels[:300])] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, list(enumerate(texts)) + [(900, None), (901, ""), (902, "---")])
    got = {r.doc_id: r for r in toxicity.score(docs, labelled).collect()}
    test = [(got[i].is_toxic, bool(labels[i])) for i in range(300, 400)]
    assert np.mean([a == b for a, b in test]) >= 0.93
    assert [got[i].toxicity for i in (900, 901, 902)] == [0, 0, 0] and not got[900].is_toxic
    assert toxicity.score(odd, labelled).count() == odd.count() and toxicity.score(none, labelled).count() == 0
    assert not any(r.is_toxic for r in toxicity.score(docs, labelled.limit(0)).collect())


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights().items()}
    ws = toxicity.Words(*common.text_bytes(pa.array(["one two three four", "five six two"])))
    which, y = np.array([0, 1]), np.array([1.0, 0.0])
    loss = lambda: float(sum(np.log1p(np.exp(-(2 * t - 1) * x)) for t, x in zip(y, toxicity.run(toxicity.project(toxicity.inputs(ws, np.arange(len(ws.hashes)), w), w), *ws.windows(which), w))) / 2)

    class Shown:
        def random(self, shape):
            return np.ones(shape)

    grads = toxicity._step(ws, which, y, np.ones(2), w, Shown())
    for k in ("u", "w", "a", "v", "o", "char", "word", "b"):
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        step = 1e-2 if k in ("word", "char") else 1e-3
        old = w[k][at]
        w[k][at] = old + step
        up = loss()
        w[k][at] = old - step
        down = loss()
        w[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05), k


def plain_logit(texts, weights):
    """The highest window of each text by plain loops over words, bytes and places."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, out = toxicity.HIDDEN, []
    for text in texts:
        raw = (text or "").encode()
        found = [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", raw)]
        xs = []
        for a, b in found:
            data, one = np.frombuffer(raw[a:b], np.uint8), raw[a:b].lower()
            bucket = int(common.span_hashes(data, np.array([0]), np.array([b - a]), fold=True)[0] % toxicity.HASHED)
            seen = [[one[p + k] if 0 <= p + k < len(one) else 256 for k in range(-toxicity.REACH, toxicity.REACH + 1)] for p in range(len(one))]
            xs.append(np.concatenate([weights["word"][bucket], np.tanh(np.max([sum(weights["char"][k][c] for k, c in enumerate(row)) for row in seen], axis=0))]))
        best = -np.inf
        for start in range(0, max(1, len(xs) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if xs else ():
            window = xs[start : start + toxicity.WINDOW]
            states = []
            for way in (0, 1):
                state, own = np.zeros(h), []
                for x in window if way == 0 else window[::-1]:
                    g, u = x @ weights["w"][way] + weights["b"][way][0], state @ weights["u"][way]
                    z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
                    state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                    own.append(state)
                states.append(own if way == 0 else own[::-1])
            both = [np.concatenate(pair) for pair in zip(*states)]
            attention = np.exp([np.tanh(s @ weights["a"]) @ weights["v"] for s in both])
            best = max(best, float(sum(w * s for w, s in zip(attention / attention.sum(), both)) @ weights["o"] + weights["c"][0]))
        out.append(best)
    return np.array(out)


def test_toxicity_equals_plain_loops():
    rng = random.Random(21)
    weights = toxicity.new_weights(3)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 31, 63, 64, 65, 96, 97, 130, 200)] + ["É cole, Ñandú!", "", "--", None, "A" * 300]
    assert np.allclose(toxicity.Scorer(weights)(pa.array(texts, pa.string())), plain_logit(texts, weights), atol=1e-4)


def test_toxic_passages_count_in_long_texts(spark):
    rng = random.Random(22)
    texts, labels = toxic_texts(rng, 300)
    texts += [" ".join(words(rng, 3000, 500)) for _ in range(30)]
    weights, threshold = toxicity.fit(texts, np.array(labels + [0] * 30, float))
    toxic = next(t for t, y in zip(texts, labels) if y)
    long = [" ".join(words(rng, 3000, 500)) for _ in range(10)]
    scores = toxicity.Scorer(weights)(pa.array([t[:9000] + " " + toxic + " " + t[9000:] for t in long] + long))
    assert (scores[:10] >= threshold).mean() >= 0.9 and (scores[10:] >= threshold).mean() <= 0.1


def test_training_texts_are_bounded_by_number(spark):
    docs = frame(spark, [(i % 50, f"text {i} " + "long " * (i * 100)) for i in range(100)] + [(60, None), (61, "")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(3, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_texts(docs, labels)
    assert len(texts) == 50 and max(map(len, texts)) > 20_000 and toxic.sum() == 25
    assert len(toxicity.training_texts(docs, labels, 7)[0]) <= 7 and len(toxicity.training_texts(docs, labels, 62, 30_000)[0]) < 50


def test_toxic_documents_go_and_all_columns_stay(spark, tmp_path, none):
    texts, labels = toxic_texts(random.Random(23), 120)
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[1])]).selectExpr("*", "doc_id AS toxicity", "false AS Is_Toxic", "1 AS `a.b`")
    left = toxicity.drop_toxic(spark, docs, str(tmp_path))
    rows = left.collect()
    assert left.columns == docs.columns and all(r.toxicity == r.doc_id and not r.Is_Toxic for r in rows)
    assert {500, 501, None} <= {r.doc_id for r in rows} and 60 < len(rows) < 123
    assert toxicity.drop_toxic(spark, none, str(tmp_path)).count() == 0


# 10


def brute_lm(rows):
    """By doc_id, for each word: its count, the longest context that occurs elsewhere too, at how many other places, and how often this word follows there."""
    texts = [(d, [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]) for d, text in rows]
    strings = Counter(tuple(ws[i:j]) for _, ws in texts for i in range(len(ws)) for j in range(i + 1, len(ws) + 1))
    out = defaultdict(list)
    for d, ws in texts:
        for i, w in enumerate(ws):
            best = max((n for n in range(1, i + 1) if strings[tuple(ws[i - n : i])] > 1), default=0)
            context = tuple(ws[i - best : i])
            out[d].append((strings[w,], best, strings[context] - 1, strings[*context, w] - 1))
    return out


def test_language_model_equals_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 500)
    rng = random.Random(12)
    rows = [(i, ". ".join(" ".join(words(rng, rng.randrange(1, 12), 25)) for _ in range(rng.randrange(1, 8))).replace("w1 ", "W1 ")) for i in range(80)]
    long = words(rng, 150, 60)
    rows += [(80, rows[0][1]), (81, "w1 w2 " * 30), (82, ""), (83, None), (81, "w3"), (84, "w3"), (85, "nowhere")]
    for k in range(6):  # near copies, long ones: contexts end at every edit
        copy = list(long)
        for _ in range(k):
            copy[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows.append((90 + k, " ".join(copy[k * 3 :])))
    got = {r.doc_id: r for r in lm.scores(frame(spark, rows).repartition(3)).collect()}
    brute = brute_lm(rows)
    size = sum(map(len, brute.values())) - 1 + len({w.lower() for _, t in rows for w in re.findall(r"\w+", t or "")})
    assert max(p[1] for d in brute for p in brute[d]) > 64
    for d, places in brute.items():
        bits = -sum(np.log2((same + count / size) / (n + 1) if best else count / size) for count, best, n, same in places)
        assert got[d].n_words == len(places) and got[d].bits_per_word == pytest.approx(bits / len(places)), d
        assert got[d].mean_context == pytest.approx(np.mean([p[1] for p in places])), d
    assert got[82].n_words == 0 and got[83].bits_per_word is None and len(got) == len({d for d, _ in rows})
    assert got[80].bits_per_word < got[1].bits_per_word, "a copy is easy to predict"
    assert lm.scores(odd).count() == 9 and lm.scores(none).count() == 0


def test_sums_are_read_alike_from_files_that_cannot_be_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 16)
    monkeypatch.setattr(lm, "BLOCKS_KEPT", 2)
    rng = np.random.default_rng(3)
    values = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (100, 37)]
    for k, v in enumerate(values):
        (tmp_path / f"f{k}").write_bytes(v.tobytes())
    file = rng.integers(0, 2, 300)
    at = np.where(file == 0, rng.integers(0, 100, 300), rng.integers(0, 37, 300))
    for mapped in (True, False):
        assert np.array_equal(lm.Sums(f"file://{tmp_path}", ["f0", "f1"], mapped)(file, at), np.where(file == 0, values[0][at], values[1][at % 37]))


def test_parts_round_trip():
    rng = np.random.default_rng(1)
    vocabulary = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1))
    part = lm.Part(7, np.arange(5) - 2, np.array([3, 0, 400, 1, 96]), vocabulary, rng.integers(0, len(vocabulary), 500))
    for a, b in zip(part, lm.Part.unpack(7, part.pack())):
        assert np.array_equal(a, b)
    assert part.inside().tolist() == [1, 2, 3, *range(1, 401), 1, *range(1, 97)]


def test_answers_for_other_texts_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 5, lm._join(lm._planes(np.array([1, 1]), 6)), 1)], "part long, range int, mark long, block binary, distinct long")
    folder = lm._by_part(rows, 1, "answers")
    assert lm._answers(folder, 0, 5, 2).tolist() == [1, 1]
    for mark, size in ((6, 2), (5, 3)):
        with pytest.raises(RuntimeError):
            lm._answers(folder, 0, mark, size)


def test_every_word_has_its_own_frequency(spark):
    names = [f"q{k}" for k in range(2000)]
    rows = [(0, " ".join(f"{w} {w}" for w in names)), (1, names[0]), (2, "new")]
    got = {r.doc_id: r for r in lm.scores(frame(spark, rows)).collect()}
    assert got[1].bits_per_word == pytest.approx(-np.log2(3 / (4001 + 2001))) and got[2].bits_per_word == pytest.approx(-np.log2(1 / (4001 + 2001)))
