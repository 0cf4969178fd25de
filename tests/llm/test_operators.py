"""The corpus operators against plain brute force on small tables, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strophe.llm import exact, langid, mixing, packing, passages, planes, quality, sharding, simhash, token_ids, vectors
from strophe.llm.common import merge, prepare
from strophe.llm.components import components

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, copy int"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def odd_rows(n=120, seed=3):
    """Rows with nulls in every column, empty and long texts, repeats, near copies and names the operators use."""
    rng = random.Random(seed)
    words = ["one", "Two", "three", "four", "é", "five", "six,", "seven.", "Eight"]
    rows = [(None,) * 8, (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 1, "x", 1)]
    rows += [(3, "Abc déf", "en", "a", 7, 1, "x", 1), (4, "aBC déf", None, None, 7, 1, None, 1), (4, "aBC déf", None, "b", 7, 1, "y", 1)]
    rows += [(None, "abc déf", "fr", "a", 7, None, "x", 1), (5, "abc dÉf", "fr", "b", 7, 1, "x", 1)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(9000))
    rows += [(6, long, "en", "b", len(long), 1, "x", 1), (7, long + " end", "en", "b", 0, 1, "x", 1), (8, " \n\t ", "en", "a", 4, 1, "x", 1)]
    for i in range(10, n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 40])))
        rows.append((i, text, "en", rng.choice("aab"), len(text), i, "x", i))
    return rows


@pytest.fixture(scope="module")
def docs(session):
    return session.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(session):
    return session.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups(docs, empty):
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = exact.exact_groups(docs, capacity=300).collect()
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), digest) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact.keep_one(docs, capacity=300)
    assert left.columns == docs.columns
    assert Counter(lowered(r.text) for r in left.collect()) == Counter(list(groups))
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert exact.exact_groups(empty).count() == 0 and exact.keep_one(empty).count() == 0


def test_colliding_keys_are_told_apart(session):
    texts = ["a", "b", "a", "c", "b", "a"]
    entries = session.createDataFrame(
        [(i, 5, i, 1, bytearray(t.encode())) for i, t in enumerate(texts)], "rep long, key long, top long, n long, body binary"
    )
    dealt = exact.owned(entries, 1 << 20).collect()
    assert [r.top for r in dealt] == [5, 4, 3, 2, 1, 0]


def test_directory_doubles_until_nothing_is_overfull():
    sizes = np.array([9, 1, 1, 1, 1, 1, 1, 1])
    depth = exact.directory_depths(sizes, 3)
    whole = int(np.log2(len(depth)))
    assert whole == 3 and depth.tolist()[:2] == [3, 3]  # one slot stays overfull: it cannot be split
    for slot, d in enumerate(depth):
        lo = slot >> (whole - d) << (whole - d)
        assert sizes[lo : lo + (1 << (whole - d))].sum() <= 3 or d == 3
        assert set(depth[lo : lo + (1 << (whole - d))]) == {d}
    assert exact.directory_depths(np.zeros(8, int), 3).tolist() == [0]


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, links):
    labels = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(labels[a], labels[b])
            if labels[a] != low or labels[b] != low:
                labels[a] = labels[b] = low
                changed = True
    return labels


def components_by_hand(ids, links):
    labels = roots(len(ids), links)
    least = {}
    for i, root in zip(ids, labels):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return [least.get(root) for root in labels]


@pytest.mark.parametrize("cell_rows", [1 << 16, 3])
def test_near_groups(docs, empty, cell_rows):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 5000]
    small = docs.where("text is null or length(text) < 5000")
    fps = [slow_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components_by_hand([r[0] for r in rows], links)
    got = simhash.near_groups(small, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want)
    )
    assert simhash.near_groups(empty).count() == 0


def test_gray_index_finds_all_components():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = []
    for _ in range(900):
        f = int(rng.choice(centres))
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            f ^= 1 << int(bit)
        fps.append(f)
    fps = np.unique(np.array(fps, np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    merge(want, *np.nonzero(near))
    assert np.array_equal(simhash.GrayIndex(fps).link(4), want)
    codes = np.arange(64, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(codes ^ codes >> np.uint64(1)), codes)


def test_dense_cells_are_divided(session):
    rng = random.Random(8)
    fps = set()
    while len(fps) < 400:
        f = 0x123456789ABCDEF0
        for bit in rng.sample(range(63), rng.randint(0, 5)):
            f ^= 1 << bit
        fps.add(f)
    fps = sorted(fps)
    links = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(len(fps), links)
    nodes = session.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.near_links(nodes, cell_rows=40)).collect()}
    mine = [got.get(f, f) for f in fps]
    assert [fps.index(m) for m in mine] == want


def test_near_copies_of_a_kept_row_go(session):
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t, i, "x") for i, t in enumerate(base)]
    for i in range(40):
        words = base[i % 4].split()
        words[rng.randrange(300)] = "other"
        rows.append((100 + i, " ".join(words), 0, None))
    rows += [(None, base[0], 1, "x"), (None, None, 2, "y"), (500, "", 2, "y"), (0, base[0], 7, "x")]
    df = session.createDataFrame(rows, "doc_id long, text string, place long, head string")
    left = simhash.keep_one(df)
    got = left.collect()
    assert left.columns == df.columns
    assert {r.doc_id for r in got if r.doc_id is not None} >= {*range(12), 500}
    assert sum(1 for r in got if r.text in base) == 12 and sum(1 for r in got if not r.text) == 1
    assert len(got) < 12 + 1 + 8
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components(session):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 100), (7, 7), (None, 3), (200, 100), (300, 301)]
    got = {r.node: r.root for r in components(session.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 102: 100, 200: 100, 300: 300, 301: 300}
    assert components(session.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_near_vectors(session, block_rows):
    rng = np.random.default_rng(2)
    rows, base = [], rng.standard_normal((6, 8))
    for i in range(150):
        v = (base[i % 6] + rng.standard_normal(8) * rng.choice([0.05, 0.2, 0.6])).astype(np.float32).tolist()
        rows.append((i, v, i % 2, "x"))
    rows += [(200 + i, rows[4][1], 0, "x") for i in range(5)]
    rows += [(300, [0.0] * 8, 0, "x"), (301, None, 0, "x"), (302, [], 0, None), (303, [None] + [1.0] * 7, 0, "x")]
    rows += [(304, [float("nan")] + [1.0] * 7, 0, "x"), (305, [float("inf")] + [1.0] * 7, 0, "x")]
    rows += [(306, rows[4][1], None, "x"), (307, rows[4][1], None, "x"), (308, rows[4][1][:4], 0, "x"), (309, rows[4][1][:4], 0, "x")]
    df = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cells string").repartition(4)

    def good(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links = []
    for a, b in combinations(range(len(rows)), 2):
        if good(rows[a]) and good(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    n_links = Counter(x for pair in links for x in pair)
    least = components_by_hand([r[0] for r in rows], links)
    want = {(r[0], n_links[i], c, c == r[0]) for i, (r, c) in enumerate(zip(rows, least))}
    got = {tuple(r) for r in vectors.near_vectors(df, block_rows=block_rows).collect()}
    assert got == want and len(links) > 200
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_units_of_odd_characters_give_the_ids_of_whole_texts():
    signs = ["a", "B", "é", "İ", "\u0301", "Σ", "ß", "한", "ᄒ", "ᅡ", "\u0958", "1", "²", "ª", "_", "'s", "'ve", ".", "=", "\u0338"]
    signs += ["\n", " ", "  ", "\t", "\u3000", "<|endoftext|>", "<|", "\ue000", "ǅ", "漢", "🙂", "\u200d"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for path in (BYTE, WORD):
        for as_text in (False, True):
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = as_text
            want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
            for memo in (50, 100_000):
                assert [x.tolist() for x in token_ids.Encoder(path, memo, as_text).encode_all(texts)] == want


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    odd = "".join(map(chr, [*range(0, 0x330), *range(0x1E00, 0x1E40), *range(0x2000, 0x2070), 0x3000, 0xE000, 0xFEFF]))
    texts = ["", "a<|endoftext|>b c", "<|endoftext|>", " x", "x ", "a  b", "don't 's '  're"]
    texts += ["".join(rng.choice(odd + "      \n\n's't12ab!,.;éé") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += [" ".join(texts[-200:]) * 40]
    for path in (BYTE, WORD):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in token_ids.Encoder(path).encode_all(texts)] == want


def test_unknown_pre_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import pre_tokenizers

    assert token_ids.Encoder(BYTE).by_units and token_ids.Encoder(WORD).by_units
    odd = Tokenizer.from_file(BYTE)
    odd.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # merges run over white space
    odd.save(str(tmp_path / "odd.json"))
    encoder = token_ids.Encoder(str(tmp_path / "odd.json"))
    texts = ["", "one two", "a  b\nc ", "<|endoftext|> x"]
    assert not encoder.by_units
    assert [x.tolist() for x in encoder.encode_all(texts)] == [e.ids for e in odd.encode_batch(texts, add_special_tokens=False)]


def ids_of(text, path):
    whole = Tokenizer.from_file(path)
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing(docs, empty):
    rows = odd_rows()
    got = packing.pack_documents(docs, BYTE, capacity=64, with_ids=True).collect()
    whole = Counter((r[0], ids_of(r[1], BYTE).tobytes()) for r in rows)
    parts, seen = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 256
        parts[r.doc_id, r.doc_tokens].append(r)
        seen[r.sequence_id].append((r.offset, r.length))
    assert sum(len(r.ids) for r in got) == sum(len(b) * n for (_, b), n in whole.items())
    for (doc, _), body in parts.items():
        if sum(1 for (d, _), n in whole.items() if d == doc for _ in range(n)) == 1:
            body.sort(key=lambda r: r.start)
            assert whole[doc, b"".join(bytes(r.ids) for r in body)] == 1
    for spots in seen.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(n for s in seen.values() for _, n in s) / (64 * len(seen)) > 0.97
    full = packing.sequences(packing.pack_documents(docs, BYTE, capacity=64, with_ids=True), 64).collect()
    assert {len(r.ids) // 4 for r in full} <= {64, 32, 16, 8, 4, 2, 1} and len(full) == len(seen)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_patterns_place_every_length():
    rng = random.Random(4)
    hist = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 60)}
    packs = packing.patterns(hist, 100)
    placed = Counter()
    for n, pattern in packs:
        assert sum(pattern) <= 100
        for length in pattern:
            placed[length] += n
    assert placed == Counter(hist) and len(packs) <= len(hist)


def test_pack_keeps_clashing_columns(session):
    df = session.createDataFrame([(5, 1, "a"), (None, 2, "b"), (3, 3, "c")], "length int, rank int, part string")
    got = {r.rank: r for r in packing.pack(df, capacity=8).collect()}
    assert got[2].sequence_id is None and got[1].sequence_id == got[3].sequence_id and got[3].offset == 5
    with pytest.raises(Exception, match="longer than"):
        packing.pack(df, capacity=4).collect()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(docs, empty, kind):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    files = planes.write_ids(docs, WORD, planes.fresh_folder(docs), planes=kind)
    got = sorted(planes.read_ids(files).collect(), key=lambda r: r.start)
    at = 0
    for r, row in zip(got, rows, strict=True):
        ids = ids_of(row[1], WORD)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    none = planes.write_ids(empty, WORD, planes.fresh_folder(docs))
    assert planes.read_ids(none).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(tmp_path, kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert np.array_equal(planes.from_planes(planes.to_planes(ids, kind), n, kind), ids)
    path = tmp_path / "x.stids"
    with open(path, "wb") as out:
        w = planes.Writer(out, kind, block=16)
        w.add(3, ids[: n // 3])
        w.add(None, ids[n // 3 :])
        w.close()
    store, inner = planes.open_store(str(path))
    with store.open_input_file(inner) as source:
        r = planes.Reader(source)
        assert r.docs == [3, None] and r.total == n
        assert np.array_equal(r.ids(0, n), ids) and np.array_equal(r.ids(n // 2, n), ids[n // 2 :])
    damaged = bytearray(path.read_bytes())
    damaged[-30] ^= 1
    path.write_bytes(damaged)
    with store.open_input_file(inner) as source, pytest.raises(ValueError):
        planes.Reader(source)


def test_mixing(docs, empty):
    got = mixing.mix(docs, power=0.0, size=40.0).collect()
    per = Counter((r.doc_id, r.text, r.source, r.row) for r in got)
    given = Counter((r[0], r[1], r[3], r[6]) for r in odd_rows())
    for r in got:
        at = r.doc_id, r.text, r.source, r.row
        assert r.copies * given[at] == per[at]
    shares = Counter(r.source for r in got)
    for source in ("a", "b", None):  # equal weights: a third of 40 times the rows each
        assert abs(shares[source] - 40 * len(odd_rows()) / 3) < 250
    assert len({r.order_key for r in got}) > 0.9 * len(got)
    assert set(docs.columns) <= set(mixing.mix(docs).columns)
    assert mixing.mix(empty).count() == 0
    only = mixing.mix(docs, weights={"b": 1.0}).select("source").distinct().collect()
    assert [r.source for r in only] == ["b"]


def test_poisson_counts_follow_the_distribution(session):
    df = session.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    for size in (0.7, 3.0, 40.0):
        counts = [r[0] for r in mixing.mix(df, size=size).groupBy("doc_id").agg(F.max("copies")).select("max(copies)").collect()]
        counts += [0] * (20000 - len(counts))
        assert abs(np.mean(counts) - size) < 4 * (size / 20000) ** 0.5
        assert abs(np.var(counts) / size - 1) < 0.06


def smallest_capacity(weights, shards):
    best = [[0] * (len(weights) + 1)] + [[None] * (len(weights) + 1) for _ in range(shards)]
    ends = np.concatenate([[0], np.cumsum(weights)])
    best[0] = [0] + [10**18] * len(weights)
    for s in range(1, shards + 1):
        for n in range(len(weights) + 1):
            best[s][n] = min(max(best[s - 1][m], int(ends[n] - ends[m])) for m in range(n + 1))
    return best[shards][len(weights)]


def test_sharding(docs, empty, session, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 1)
    rows = odd_rows()
    got = sharding.shard_by_bytes(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    home = defaultdict(set)
    for r in got:
        home[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    rng = random.Random(6)
    for n, most in ((1, 9), (3, 9), (40, 9), (40, 1000)):
        keys = sorted({rng.getrandbits(63) for _ in range(n)})
        weights = [rng.randint(1, most) for _ in keys]
        groups = session.createDataFrame(list(zip(keys, weights)), "key long, weight long")
        ends, capacity = sharding.minimax_cuts(groups, 5)
        assert capacity == smallest_capacity(weights, 5)
        sums = Counter()
        for k, w in zip(keys, weights):
            sums[sum(k >= e for e in ends)] += w
        assert max(sums.values()) == capacity and max(sums) < 5
    assert sharding.shard_by_bytes(empty).count() == 0


def test_language(session, empty):
    rng = random.Random(9)
    parts = {"en": "the ing th sh ed", "de": "sch ung der ich ei", "fr": "eau ou le que ment", "es": "ción os que llo ar"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang].split(), k=3)) for _ in range(rng.randint(5, 60))), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "en"), (None, "the thing", "en"), (903, "thing " * 99999, None)]
    df = session.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, row string")
    got = langid.detect(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not langid.has_letter(r.text)) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]) > 0.97
    assert langid.detect(empty).count() == 0
    assert {r.lang_pred for r in langid.detect(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(session, empty):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        good = rng.random() < 0.8
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(rng.randint(5, 400))]
        if not good:  # one bad passage in a long text
            at = rng.randrange(len(words))
            words[at : at + 1] = ["### $$$ 99"] * 30
        rows.append((i, " ".join(words), "x", 1))
        if i % 5:
            marks.append((i, int(good), None))
    truth = {i: q for i, q, _ in marks}
    rows += [(900, None, None, None), (901, "", "x", 1), (None, "lorem", "x", 1), (902, "ipsum " * 99999, "x", 1)]
    marks += [(None, 1, 0), (3, 1 - truth.get(3, 0), 1), (4, None, 0), (77777, 1, 1)]
    docs = session.createDataFrame(rows, "doc_id long, text string, row string, score int")
    labels = session.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.rate(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a > b for y, a in held if y for z, b in held if not z]) > 0.95
    assert {r.score for r in quality.rate(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.rate(empty, labels).count() == 0


def test_attention_gradients_and_running_sums():
    rng = np.random.default_rng(1)
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    x, first, y, weight = rng.standard_normal((7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        prob = model.gradients(x, first, y, weight)[1]
        return -(weight * (y * np.log(prob) + (1 - y) * np.log(1 - prob))).sum()

    grads = model.gradients(x, first, y, weight)[0]
    for name, p in model.p.items():
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        slope = (up - loss()) / 2e-5
        p[at] += 1e-5
        assert abs(slope - grads[name][at]) < 1e-6
    body = rng.integers(32, 123, 3 * quality.WINDOW // 2 + 17, dtype=np.uint8).tobytes()
    whole = np.concatenate(list(quality.passages(body)))
    assert abs(model.score(body) - model.gradients(whole, np.array([0]), np.array([1]), np.ones(1))[1][0]) < 1e-9


def test_repeated_passages(session, empty):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    shared = {"a": fresh(80), "b": fresh(60), "c": fresh(30)}
    want, rows = set(), []
    for i in range(40):
        words = fresh(rng.randint(0, 300))
        for name in rng.choice(["", "", "a", "b", "ab", "c"]):
            copy = [w.upper() if rng.random() < 0.3 else w for w in shared[name]]
            for _ in range(rng.randint(0, 1)):  # a change, also of length
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], fresh(1), fresh(2)])
            words += copy + fresh(rng.randint(0, 9))
            if name != "c":
                want.add((i, name))
        rows.append((i, " ".join(words), "x", 0))
    rows += [(100, None, "x", 0), (101, "", None, None), (None, rows[0][1], "x", 0), (102, rows[1][1], "x", 0), (102, rows[1][1], "x", 0)]
    rows.append((103, "same words again " * 5000, "x", 0))
    df = session.createDataFrame(rows, "doc_id long, text string, pair string, start int").repartition(3)
    got = passages.repeated_passages(df).collect()
    texts = {r[0]: passages.split((r[1] or "").encode()) for r in rows}
    for r in got:
        one, two = (texts[i][s : s + n] for i, s, n in ((r.doc_id, r.start, r.words), (r.other_id, r.other_start, r.other_words)))
        assert max(len(one), len(two)) >= 50 and r.equal_words >= 0.8 * max(len(one), len(two))
        assert sum((Counter(one) & Counter(two)).values()) >= r.equal_words
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    per = Counter(name for _, name in want)
    assert {i for i, name in want if per[name] > 1} <= found
    clean = {i for i in range(40) if not any((i, n) in want for n in "ab")} - {0, 1}
    assert not clean & found and not {100, 101, 103} & found and {None, 102, 0, 1} <= found
    assert passages.repeated_passages(empty).count() == 0


def test_chains_are_the_best_by_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 9)
        spots = sorted((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(n))
        xs, ys = [p for p, _ in spots], [q for _, q in spots]

        def worth(path):
            return len(path) - 0.02 * sum(xs[b] - xs[a] + ys[b] - ys[a] for a, b in zip(path, path[1:]))

        paths = [p for k in range(2, n + 1) for p in combinations(range(n), k)
                 if all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(p, p[1:]))]
        got = passages.chain(xs, ys)
        if paths:
            assert abs(worth(got[0]) - max(map(worth, paths))) < 1e-9
        else:
            assert got == []
        assert len({m for p in got for m in p}) == sum(map(len, got))
