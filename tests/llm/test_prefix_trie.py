import hashlib
import zlib

from lodestar.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, rep long, e int, n int"


def brute(rows):
    """Nodes of the trie by the contract, from plain lists."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - int(c / 100) * 100 if c < 0 else c - c % 100, [])
        built[c] = head[:h] + turns[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for key, members in nodes.items():
        d = len(key)
        sub = [k for k in nodes if k[:d] == key]
        ends = sorted(c for c in members if len(built[c]) == d)
        out.add((
            min(members), d, min(nodes[key[:-1]]) if d else None, len(members),
            sum(1 for k in sub if len(k) == d + 1),
            sum(1 for k in sub if not any(len(j) > len(k) and j[: len(k)] == k for j in nodes)),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in sub if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_trie_matches_brute_force_with_odd_rows(spark):
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 100, 101, 102, 150, 201, 300]:
        for t in range(c % 4 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {t} {c % 3}"))
    rows += [
        (0, None, "system", "first"), (1, 1, None, None), (1, 1, None, None), (2, 9, "user", "héllo 😀"),
        (None, 1, "user", "no conversation"), (400, None, None, None), (401, 3, "user", "x" * 20_000),
    ]
    full = [(*r, 9, 9, 9, 9) for r in rows]
    got = rows_of(prefix_trie(spark.createDataFrame(full, SCHEMA)))
    assert got == brute(full)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 7) for t in range(4)]
    full = [(*r, 0, 0, 0, 0) for r in rows]
    assert rows_of(prefix_trie(spark.createDataFrame(full, SCHEMA))) == brute(full)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
