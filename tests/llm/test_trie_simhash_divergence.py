"""The prefix trie, the SimHash join and the divergence audit against brute force: planted cases, nulls, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
import xxhash

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]
from textloom.llm import divergence, prefix_trie, simhash
from textloom.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---- prefix trie


def trie_of(rows):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    for c in own:
        own[c] = [(r, t) for _, _, r, t in sorted(own[c])]
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h]) + tuple(turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in made.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def got_trie(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*prefix_trie.NODE_COLUMNS).collect())


SCHEMA = "conv_id long, turn long, role string, text string, node string, KEYS int"


def test_trie_random(spark, monkeypatch, seed=0):
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 7)  # many runs a task, merged by the tree
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(700), 150) + [100, 200, -3]:
        for t in range(rng.choice([1, 2, 3, 8, 30])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "dé"])))
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(9)]  # a large group of copies
    rows += [(None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = got_trie(prefix_trie.trie(df))
    assert got == trie_of(rows)


def test_trie_whole(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(QUERIES["op11_prefix_trie"](spark, sf)) == trie_of(rows)


def test_trie_edges(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", "", 1)], SCHEMA)).collect() == []
    # 101's first two turns come from an absent conversation, and it has no more: a member of the root only
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    one = prefix_trie.trie(spark.createDataFrame([(c, 1, "user", "x", "", 1), (c, 2, None, None, "", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    long = [(0, t, "user", "w" * 50_000 if t == 3 else str(t), "", 1) for t in range(200)]
    assert got_trie(prefix_trie.trie(spark.createDataFrame(long, SCHEMA))) == trie_of([r[:4] for r in long])


def test_loser_tree():
    rng = random.Random(5)
    key = lambda s: b"".join(bytes([c]) * 16 for c in s)
    for k in (1, 2, 3, 5, 8, 13):
        seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(7))) for _ in range(150)})
        runs = [[] for _ in range(k)]
        for s in seqs:
            runs[rng.randrange(k)].append(key(s))
        cursors = []
        for run in filter(None, runs):
            lcp = [0, *(prefix_trie.shared(a, b) for a, b in itertools.pairwise(run))]
            cursors.append(prefix_trie.Run(lcp, [r[16 * n :] for r, n in zip(run, lcp, strict=True)], [[1] * (len(r) // 16 - n) for r, n in zip(run, lcp, strict=True)], [1] * len(run), [0] * len(run), [""] * len(run)))
        before, out = b"", []
        for run in prefix_trie.merged(cursors):
            assert run.lcp == prefix_trie.shared(before, run.keys)
            out.append(before := run.keys)
        assert out == [key(s) for s in seqs]


# ---- SimHash


def fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_connected(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    least = {}
    for i, x in enumerate(ids):
        least.setdefault(find(i), []).append(x)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = [fingerprint(r.text) for r in rows]
    comp = least_connected([r.doc_id for r in rows], [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4])
    got = QUERIES["op13_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fp, comp, strict=True)}
    assert len(got) == len(rows)


def test_links_of_fingerprints(spark, seed=0):
    """Chains, dense balls and far points: every pair of at most four bits is found, none of five."""
    rng = random.Random(seed)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                x ^= 1 << b
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):  # a chain
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    want = least_connected(signed, [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    nodes = spark.createDataFrame([(s, 1) for s in signed], "fp long, copies long")
    got = {r.node: r.root for r in simhash.link_components(nodes).collect()}
    assert {s: got.get(s, s) for s in signed} == dict(zip(signed, want, strict=True))


def test_simhash_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e"), (5, "A b C d e"), (5, "a b c d e"), (7, "one two"), (8, long), (9, long + " end"), (None, None)]
    df = spark.createDataFrame([(i, t, i, 1, 2) for i, t in rows], "doc_id long, text string, fp long, cell int, root int")
    got = simhash.near_components(df).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64) for r in got) == collections.Counter((i, fingerprint(t)) for i, t in rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 8, 9: 8}
    assert {r.component_id for r in got if r.doc_id is None} == {1, 5}
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="differing bits"):
        simhash.near_components(df, distance=5)


# ---- divergence audit


def audit_of(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))] for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        docs = collections.Counter(t for w, _ in mine for t in set(w))
        kept = {t for t, n in docs.items() if n >= least}
        sources = {s for _, s in mine}
        count = {s: collections.Counter(t for w, x in mine if x == s for t in w if t in kept) for s in sources}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("groups", [divergence.BROADCAST_GROUPS, 0])
def test_audit(spark, monkeypatch, groups):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", groups)
    rng = random.Random(3)
    vocab = ["un", "deux", "Ünder", "été", "x", "A", "b2b", "日本", "𝕏y", "zz"]
    rows = [(" ".join(rng.choices(vocab, k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "é", "Z"])) for _ in range(200)]
    rows += [(None, "en", "s9"), ("", "de", "a"), ("12 34", "de", "b"), ("rare words only", "de", None), ("only", "nl", "lone"), ("un " * 20_000, "en", "s1")] + [("same text", "en", "s1")] * 12
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n int, total int, term string")
    got = divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(tuple(r) for r in got) == audit_of(rows)
    assert divergence.audit(df.limit(0)).collect() == []
