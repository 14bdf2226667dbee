"""Run time and memory of the aligner over lengths and error rates: ``python -m wordloom.plans.harness``.

Prints ``length,ins,del,sub,pairs,seconds,pairs_per_s,ram_mb`` for each configuration.
"""

from __future__ import annotations

import random
import resource
import sys
import time

from wordloom.operators.align import align_words, counts

# Words, shares of insertions, deletions and substitutions, repeats.
CONFIGURATIONS = [
    (1_000, 0.1, 0.1, 0.1, 5), (1_000, 0.2, 0.2, 0.2, 5), (1_000, 0.3, 0.3, 0.3, 5), (1_000, 0.1, 0.1, 0.4, 5), (1_000, 0.1, 0.4, 0.1, 5), (1_000, 0.4, 0.1, 0.1, 5),
    (100, 0.1, 0.1, 0.1, 10), (200, 0.1, 0.1, 0.1, 10), (400, 0.1, 0.1, 0.1, 10), (800, 0.1, 0.1, 0.1, 5), (2_000, 0.1, 0.1, 0.1, 5), (4_000, 0.1, 0.1, 0.1, 2), (8_000, 0.1, 0.1, 0.1, 2), (16_000, 0.1, 0.1, 0.1, 2), (32_000, 0.1, 0.1, 0.1, 2),
]


def made_pair(length: int, ins: float, dels: float, subs: float, seed: int = 0, vocabulary: int = 10_000) -> tuple[list[str], list[str], int]:
    """A reference, a hypothesis with so many errors, and the number of errors made.

    No insertion stands beside a deletion, since the two would be one substitution.
    """
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary):06d}"
    ref = [word() for _ in range(length)]
    want = ["ins"] * round(ins * length) + ["del"] * round(dels * length) + ["sub"] * round(subs * length)
    want += ["cor"] * max(0, length - len(want))
    rng.shuffle(want)
    hyp: list[str] = []
    made, last = 0, "cor"
    for w, op in zip(ref, want, strict=False):
        if {op, last} == {"ins", "del"}:
            op = "cor"
        made += op != "cor"
        if op != "del":
            hyp.append(word() if op == "sub" else w)
        if op == "ins":
            hyp.append(word())
        last = op
    return ref, hyp + ref[len(want) :], made


def measure(length: int, ins: float, dels: float, subs: float, repeats: int) -> dict[str, float]:
    """Seconds and memory of aligning ``repeats`` pairs of a configuration."""
    pairs = [made_pair(length, ins, dels, subs, seed) for seed in range(repeats)]
    began = time.perf_counter()
    for ref, hyp, made in pairs:
        c = counts(align_words(ref, hyp))
        assert c["ins"] + c["del"] + c["sub"] <= made
    spent = time.perf_counter() - began
    ram = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    return {"length": length, "ins": ins, "del": dels, "sub": subs, "pairs": repeats, "seconds": round(spent, 4), "pairs_per_s": round(repeats / spent, 2), "ram_mb": round(ram)}


def main() -> None:
    for i, c in enumerate(sorted(CONFIGURATIONS, key=lambda c: c[0])):
        row = measure(*c)
        if i == 0:
            print(",".join(row))
        print(",".join(str(v) for v in row.values()), flush=True)


if __name__ == "__main__":
    sys.exit(main())
