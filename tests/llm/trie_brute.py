"""The prefix trie in plain Python, for the tests."""

import hashlib
import zlib


def brute_trie(rows, spread=100, heads=6):
    """rows: (conv_id, turn, role, text); result rows as the operator gives them, sorted."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        convs.setdefault(conv, []).append((turn, role, text))
    ordered = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1] is None, t[1] or "", t[2] is None, t[2] or ""))
        ordered[conv] = [(r or "", t or "") for _, r, t in turns]
    rebuilt = {}
    for conv, turns in ordered.items():
        h = zlib.crc32(str(conv).encode()) % heads
        base = conv - (abs(conv) % spread) * (1 if conv >= 0 else -1)
        rebuilt[conv] = ordered.get(base, [])[:h] + turns[h:]
    nodes = {}
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for prefix, members in nodes.items():
        d = len(prefix)
        kids = [p for p in nodes if len(p) == d + 1 and p[:d] == prefix]
        sub = [p for p in nodes if len(p) >= d and p[:d] == prefix]
        leaves = sum(1 for p in sub if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in sub if p)
        ends = ",".join(str(x) for x in sorted(m for m in members if len(rebuilt[m]) == d))
        parent = min(nodes[prefix[:-1]]) if d else None
        out.append((min(members), d, parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))
