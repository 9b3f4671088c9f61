"""Plain-Python models of the engine's operators, for comparison."""

from collections import Counter


def rep(motif, n, phase=0):
    motif = motif.encode() if isinstance(motif, str) else bytes(motif)
    return bytes(motif[(i + phase) % len(motif)] for i in range(n))


def replace(seq, left, right, new):
    out, i = [], 0
    while i < len(seq):
        if i + 1 < len(seq) and (seq[i], seq[i + 1]) == (left, right):
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def mine(sequences, first_id, budget, gate):
    work, rules = [list(s) for s in sequences], []
    for k in range(budget):
        pairs = Counter(p for s in work for p in zip(s, s[1:]))
        total = sum(pairs.values())
        lefts, rights = Counter(), Counter()
        for (a, b), n in pairs.items():
            lefts[a] += n
            rights[b] += n
        best = None
        for (a, b), n in pairs.items():
            if n < gate.min_frequency or n / total < gate.min_support:
                continue
            lift = n / (float(lefts[a]) * float(rights[b]) / float(total))
            if lift >= gate.min_lift:
                best = min(best or (1.0,), (-n * lift, a, b, n)) if best else (-n * lift, a, b, n)
        if not best:
            break
        _, a, b, n = best
        rules.append((first_id + k, a, b, n))
        work = [replace(s, a, b, first_id + k) for s in work]
    return rules


def encode(data, rules):
    seq = list(data)
    for i, a, b, _ in rules:
        seq = replace(seq, a, b, i)
    return seq


def fnv(values):
    h = 1469598103934665603
    for v in values:
        for k in range(8):
            h = ((h ^ ((v >> (8 * k)) & 255)) * 1099511628211) % 2**64
    return h
