"""Naive reference implementations used as test oracles."""
from __future__ import annotations

SEP, SENT = b"\xff", b"\x00"


def shard_bytes(texts: list[str]) -> bytes:
    return b"".join(SEP + t.encode() for t in texts) + SENT


def overlap_count(text: str, q: str) -> int:
    tb, qb = text.encode(), q.encode()
    return sum(1 for i in range(len(tb) - len(qb) + 1) if tb[i:i + len(qb)] == qb)


def suffix_array(buf: bytes) -> list[int]:
    return sorted(range(len(buf)), key=lambda i: buf[i:])


def find(texts: list[str], q: str) -> tuple[int, int]:
    buf = shard_bytes(texts)
    qb = q.encode()
    sa = suffix_array(buf)
    lo = sum(1 for p in sa if buf[p:p + len(qb)] < qb)
    cnt = sum(1 for p in sa if buf[p:p + len(qb)] == qb)
    return lo, lo + cnt


def doc_of(texts: list[str], ptr: int) -> int:
    off = 0
    for i, t in enumerate(texts):
        nxt = off + 1 + len(t.encode())
        if ptr < nxt or i == len(texts) - 1:
            return i
        off = nxt
    return len(texts) - 1


def search(shards: list[list[str]], q: str, max_results: int, ctx: int):
    """Round-robin loop over shards: (shard, rank, local doc, doc_len, disp_len, needle_offset, bytes)."""
    qb = q.encode()
    per = []
    for texts in shards:
        buf = shard_bytes(texts)
        sa = suffix_array(buf)
        lo, hi = find(texts, q)
        per.append((texts, buf, sa, lo, hi))
    out, ptrs = [], [p[3] for p in per]
    while len(out) < max_results:
        moved = False
        for s, (texts, buf, sa, lo, hi) in enumerate(per):
            if len(out) >= max_results:
                break
            if ptrs[s] < hi:
                ptr = sa[ptrs[s]]
                d = doc_of(texts, ptr)
                start = sum(1 + len(t.encode()) for t in texts[:d]) + 1
                end = start + len(texts[d].encode())
                a = max(start, max(ptr - ctx, 0))
                b = min(end, ptr + len(qb) + ctx)
                out.append((s, ptrs[s], d, end - start, max(b - a, 0), max(ptr - a, 0), buf[a:b] if b > a else b""))
                ptrs[s] += 1
                moved = True
        if not moved:
            break
    return out
