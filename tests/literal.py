"""Row-by-row forms of functions, to hold the expressions against."""

import re

from readloom.functions.leader import ANY_OF, LEADERS, LEAST_LONG, LEAST_SHORT, LONG_INTRON, MOST_EXON, MOST_WRONG, OFFSETS, SHORT_INTRON

BITS = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 16}


def cigar_ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar or "")]


def listed(cigar, md, pos, seq=None):
    """(type, place in the read, length, place on the reference, reference base, read base, bits) of each difference."""
    gaps, subs, read, ref, aligned = [], {}, 0, 0, []
    for n, op in cigar_ops(cigar):
        if op in "M=X":
            for i in range(n):
                if op == "X":
                    subs[len(aligned)] = [read + i, ref + i, None]
                aligned.append((op, read + i, ref + i))
            read, ref = read + n, ref + n
        elif op == "I":
            gaps.append((3, read + 1, n, pos + ref - 1, None, None, 0))
            read += n
        elif op in "DN":
            gaps.append(({"D": 2, "N": 4}[op], read, n, pos + ref, None, None, 0))
            ref += n
        elif op == "S":
            read += n
    at = 0
    for number, deleted, base in re.findall(r"([0-9]+)|(\^[A-Za-z]+)|([A-Za-z])", md or ""):
        if number:
            at += int(number)
        elif base:
            op, i, j = aligned[at]
            if op == "M" or op == "X":
                subs[at] = [i, j, base]
            at += 1
    rows = []
    for i, j, base in subs.values():
        own = seq[i] if seq and i < len(seq) else None
        rows.append((1, i + 1, 1, pos + j, base, own, BITS.get(base, 0) + (32 if own and own.upper() == "N" else 0)))
    return sorted(gaps, key=lambda d: (d[1], d[0])) + sorted(rows, key=lambda d: d[1])


def _agrees(seq, end, expected, most_wrong, least, same):
    wrong = right = 0
    for i, x in enumerate(expected):
        at = end - i
        if at < 0:
            break
        good = at < len(seq) and same(seq[at], x)
        right, wrong = right + good, wrong + (not good)
        if wrong > most_wrong:
            return False
    return right >= least


def leader_intron(cigar, seq, reverse):
    """(length of the leader's intron, long or short), or (0, None)."""
    ops, seq = cigar_ops(cigar), seq or ""
    if reverse:
        ops, seq = ops[::-1], seq.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    clipped = 0
    if ops and ops[0][1] == "S":
        if len(ops) < 4:
            return 0, None
        clipped, ops = ops[0][0], ops[1:]
    if len(ops) < 3 or ops[0][1] != "M" or not 2 <= ops[0][0] <= MOST_EXON or ops[1][1] != "N":
        return 0, None
    exon, intron = ops[0][0], ops[1][0]
    end = exon + clipped - 1
    if exon >= LEAST_LONG - MOST_WRONG and intron >= LONG_INTRON:
        for offset in OFFSETS:
            if _agrees(seq, end + offset, ANY_OF, MOST_WRONG, LEAST_LONG, lambda a, b: a.upper() in b) and any(_agrees(seq, end + offset, x[::-1], MOST_WRONG, LEAST_LONG, str.__eq__) for x in LEADERS):
                return intron, "long"
    elif intron >= SHORT_INTRON:
        if any(_agrees(seq, end + offset, x[::-1], 0, LEAST_SHORT, str.__eq__) for offset in OFFSETS for x in LEADERS[:2]):
            return intron, "short"
    return 0, None
