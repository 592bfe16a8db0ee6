"""Manifest, embeddings and conversation repair against plain loops, and their edge cases."""

import collections
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from aforo.llm import conversation_repair as cr
from aforo.llm import embedding_dedup as ed
from aforo.llm import merkle

SF = "/root/testdata/sf0.001"


# 11 manifest


def postorder(n, fan):
    """(level, number) of all nodes, recursively."""
    height = merkle.height_of(n, fan)

    def walk(level, j):
        if level:
            for k in range(j * fan, min(j * fan + fan, -(-n // fan ** (level - 1)))):
                yield from walk(level - 1, k)
        yield level, j

    return list(walk(height, 0)), height


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_places_are_those_of_the_postorder(fan):
    for n in (1, 2, 3, 4, 15, 16, 17, 31, 33, 80, 255, 256, 257, 300):
        nodes, height = postorder(n, fan)
        assert [merkle.place(level, j, n, height, fan) for level, j in nodes] == list(range(len(nodes)))
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        log = merkle.append_log(leaves, height, fan)
        assert len(log) == len(nodes) and [log[merkle.place(0, i, n, height, fan)] for i in range(n)] == leaves


def plain_tree(leaves, fan):
    """The root, and each leaf's siblings (left, right) level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([hashlib.sha256("".join(now[i : i + fan]).encode()).hexdigest() for i in range(0, len(now), fan)])
    paths = []
    for i in range(len(leaves)):
        path, j = [], i
        for now in levels[:-1]:
            start = j - j % fan
            path.append(("".join(now[start:j]), "".join(now[j + 1 : start + fan])))
            j //= fan
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows, fan):
    """rows of (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row).encode()).hexdigest()

    trees = collections.defaultdict(list)
    for r in rows:
        low = r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])
        claim = leaf((*r[:4], low)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), claim, r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fan) for s in names}
    root, above = plain_tree([built[s][0] for s in names], fan)
    out = []
    for s, up in zip(names, above):
        for (_, _, h, claim, doc_id), path in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1]):
            node = claim or h
            for left, right in path + up:
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path + up).encode()).hexdigest()
            out.append((doc_id, h, built[s][0], root, proof, node, node == root))
    return collections.Counter(out)


def manifest_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "a", "é", "", "z" * 40, None]), rnd.choice(["en", None]), rnd.choice([0, 12, None]), rnd.choice(["Ab C", "", None, "ÄÖ x", "lower", "LONG " * 9000])) for i in range(130)]
    return [*rows, *rows[:7], (None, "a", None, None, None), (None, "a", None, None, "X"), (None, None, None, None, None), (-5, "one", "en", 3, "Xyz")]


@pytest.mark.parametrize("fan,height", [(16, 3), (2, 1), (3, 2)])
def test_manifest_equals_plain_loops(spark, fan, height):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, tree string, idx int").repartition(3)
    held = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    from pyspark.sql import functions as F

    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_hash(*held, F.translate("text", merkle.UPPER, merkle.LOWER)))
    got = merkle.manifest(docs.select("doc_id", "source", merkle.leaf_hash(*held, docs.text).alias("digest"), claim.alias("claim"), "tree"), fan, height)
    assert collections.Counter(map(tuple, got.collect())) == plain_manifest(rows, fan)


def test_manifest_query_on_odd_tables(spark, tmp_path):
    for name, rows in (("some", manifest_rows()), ("one", [(1, None, None, None, None)]), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").write.parquet(f"{path}/documents.parquet")
        got = merkle.op11_merkle_manifest(spark, path)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert collections.Counter(map(tuple, got.collect())) == (plain_manifest(rows, 16) if rows else collections.Counter())


# 12 embeddings


def plain_links(rows, threshold):
    """rows of (vec_id, label, vector): n_links and component of each row."""

    def fine(r):
        return r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fine(a) and fine(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = (np.array(v, np.float64) / np.abs(v).max() for v in (a[2], b[2]))
                if (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return collections.Counter((r[0], links[i], (c := least.get(find(i))), r[0] == c) for i, r in enumerate(rows))


def vector_rows(size):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, size))
    rows = [(i, int(rnd.integers(3)), (centres[rnd.integers(6)] + rnd.normal(size=size) * rnd.choice([0.05, 0.3, 0.4])).tolist()) for i in range(160)]
    rows += [(200 + i, 1, centres[0].tolist()) for i in range(25)]  # copies
    return [*rows, *rows[:5], (None, 1, centres[0].tolist()), (None, 2, centres[1].tolist()), (300, None, centres[0].tolist()), (301, 1, None), (302, 1, []), (303, 1, [0.0] * size)]


@pytest.mark.parametrize("tile,kind", [(2048, "double"), (7, "float")])
def test_near_vectors_equal_all_pairs(spark, tile, kind):
    rows = vector_rows(12)
    rows += [(304, 1, [float("nan")] * 12), (305, 1, [None] + [1.0] * 11), (306, 1, [float("inf")] * 12), (307, 1, [1.0, 2.0]), (308, 1, [2.0, 4.0]), (309, 1, rows[0][2][:11])]
    if kind == "double":
        rows += [(310, 0, [1e200] * 12), (311, 0, [1e-200] * 12)]
    else:
        rows = [(a, b, v and [x if x is None else float(np.float32(x)) for x in v]) for a, b, v in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, node int, tile string").repartition(3)
    assert collections.Counter(map(tuple, ed.near_vectors(df, tile=tile).collect())) == plain_links(rows, ed.THRESHOLD)


def test_near_vectors_of_small_tables(spark):
    for rows in ([], [(1, 1, [1.0, 0.0])], [(1, 1, None)], [(4, 1, [3.0]), (2, 1, [1.0]), (3, 1, [-1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
        assert collections.Counter(map(tuple, ed.near_vectors(df).collect())) == plain_links(rows, ed.THRESHOLD)


def test_bounds_keep_all_links():
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(40, 48))
    a, b = (base[rnd.integers(40, size=300)] + rnd.normal(size=(300, 48)) * 0.33 for _ in range(2))
    axes = np.linalg.qr(rnd.normal(size=(48, 48)))[0]
    sides = [ed.Side(x.tobytes(), "<f8", axes) for x in (a, b)]
    got = {p for start in range(0, 300, 100) for p in zip(*(x.tolist() for x in ed.linked(*sides, start, start + 100, 0.93)))}
    cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert got == set(zip(*(x.tolist() for x in np.nonzero(cos >= 0.93)))) and len(got) > 200


# 13 conversations


def cheapest(rows):
    """(cost, audit, lines) by a search over all edits; rows of (letter, gone, truncated, role, text)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, list(lines)
        nxt, role = (3, "assistant") if q == 2 else (2, "user")
        heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*lines, f"{role}:")))
        if i < len(rows):
            letter, gone, truncated, own, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, lines))
            if not gone:
                extra = 5 * truncated
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, nxt, (*lines, f"{role}:{text}")))
                if letter == "s" and q == 0:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, 1, (*lines, f"{own}:{text}")))
                elif letter == role[0]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, nxt, (*lines, f"{own}:{text}")))


def plain_repair(turns):
    """turns of (conv_id, turn, role, text), in order within a conversation."""
    out = collections.Counter()
    by = collections.defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    for c, own in by.items():
        rows, seen, count = [], set(), collections.Counter()
        for _, _, role, _, text in sorted(own):
            core = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows)
        out[c, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [1, 2, 4])
def test_block_tables_equal_a_search(block):
    rnd, table = random.Random(block), cr.Tables(block)
    for _ in range(400):
        symbols = [rnd.randrange(9) for _ in range(rnd.randrange(14))]
        rows = [("sua?"[x >> 1] if x < 8 else "u", x == 8, bool(x < 8 and x & 1), "", "") for x in symbols]
        want = cheapest(rows)
        letters, state = table.trace(symbols, 0, 0)
        assert "".join(letters) + table.closing(state) == want[1]
        cut = rnd.randrange(len(symbols) + 1)  # two pieces put together
        lefts, _ = table.summary(symbols[cut:])
        _, leaves = table.summary(symbols[:cut])
        right, between = int(lefts[0]), int(leaves[int(lefts[0])][0])
        one, two = table.trace(symbols[:cut], right, 0), table.trace(symbols[cut:], 0, between)
        assert one[1] == between and one[0] + two[0] == letters and two[1] == state


def conversation_rows():
    rnd = random.Random(9)
    texts = ["Hello there.", "What now?", "no end", "", " \t\n", "Stop!", "a.b", "…", "x\x0b.", " "]
    rows = [(c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", " ", "", "u", "apple"]), rnd.choice(texts)) for c in range(25) for _ in range(rnd.randrange(9))]
    long = [(1000, i, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice([f"Turn {i}.", f"turn {i}", "Again.", ""])) for i in range(700)]
    return [*rows, *long, *long[:40], (None, 3, "user", "Yes."), (None, None, "assistant", "No."), (2000, 0, "user", "long " * 60_000 + ".")]


def test_repair_equals_a_search(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, fault string").repartition(3)
    assert collections.Counter(map(tuple, cr.repair(df).collect())) == plain_repair(rows)


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_repair_query_on_odd_tables(spark, tmp_path):
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    some = [*conversation_rows(), (3000, 1, None, None), (3000, None, None, "x."), (dropped + 10**6, None, None, None)]
    for name, rows in (("some", some), ("lost", [(dropped, 0, "user", "Hi.")]), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
        damaged = plain_damage(rows)
        done = {r[0]: r[1:] for r in plain_repair(damaged)}
        want = collections.Counter()
        for c in {r[0] for r in rows}:
            turns = {t for d, t, _, _ in damaged if d == c and t is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            want[c, gaps, *done.get(c, (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))] += 1
        assert collections.Counter(map(tuple, cr.op13_conversation_repair(spark, path).collect())) == want
