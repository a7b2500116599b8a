"""Folds over the events of a key in order of time: rate limits, runs of failures, paced requests.

A fold is a function from a memo (plain values that JSON can hold; empty at first) and all
rows of one moment to the new memo and one tuple of results for each row.  The same folds
run over batches and streams.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

Memo = dict[str, Any]
Fold = Callable[[Memo, int, list[dict]], tuple[Memo, list[tuple]]]


def trailing_limit(limit: int, seconds: int = 3600) -> tuple[Fold, str]:
    """n_recent (rows of the last ``seconds`` up to now, lower bound left out), limited, retry_after (whole seconds, 1 at least, while limited)."""
    span = seconds * 1_000_000

    def fold(memo: Memo, now: int, rows: list[dict]) -> tuple[Memo, list[tuple]]:
        times = [t for t in memo.get("times", []) if t > now - span] + [now] * len(rows)
        limited = len(times) > limit
        wait = max(1, -((now - times[0] - span) // 1_000_000)) if limited else None
        return {"times": times}, [(len(times), limited, wait)] * len(rows)

    return fold, "n_recent long, limited boolean, retry_after long"


def failure_counter(failed: str, order: str, most: int = 3) -> tuple[Fold, str]:
    """failures (rows that failed in a row, up to this one) and active (false from the first run of ``most`` on).

    ``failed`` is a column of booleans, null counts as no failure; rows of one moment go by ``order``.
    """

    def fold(memo: Memo, now: int, rows: list[dict]) -> tuple[Memo, list[tuple]]:
        run, active, out = memo.get("run", 0), memo.get("active", True), {}
        for i in sorted(range(len(rows)), key=lambda i: rows[i][order]):
            run = run + 1 if rows[i][failed] else 0
            active = active and run < most
            out[i] = (run, active)
        return {"run": run, "active": active}, [out[i] for i in range(len(rows))]

    return fold, "failures long, active boolean"


def paced(tokens: str, order: str, most_requests: int | None, most_tokens: int | None, seconds: int = 60) -> tuple[Fold, str]:
    """sent: when each request goes out, in microseconds, if a client sends one after the other.

    In any ``seconds`` it sends ``most_requests`` and ``most_tokens`` at most, but a request
    that is larger by itself goes out when nothing else did so.  A request that has to
    wait looks again when the oldest one is ``seconds`` old, a tenth of a second later at
    least.  Null tokens cost nothing; requests of one moment go by ``order``.
    """
    span, least = seconds * 1_000_000, 100_000

    def fold(memo: Memo, now: int, rows: list[dict]) -> tuple[Memo, list[tuple]]:
        sent, clock, out = [tuple(x) for x in memo.get("sent", [])], memo.get("clock", now), {}
        for i in sorted(range(len(rows)), key=lambda i: rows[i][order]):
            cost, clock = int(rows[i][tokens] or 0), max(clock, now)
            while True:
                sent = [x for x in sent if clock - x[0] < span]
                room = not most_requests or len(sent) < most_requests
                if room and (not most_tokens or not sent or sum(x[1] for x in sent) + cost <= most_tokens):
                    break
                clock += max(least, span - (clock - sent[0][0]))
            sent.append((clock, cost))
            out[i] = (clock,)
        return {"sent": sent, "clock": clock}, [out[i] for i in range(len(rows))]

    return fold, "sent long"
