"""Calls to a model behind any function that sends a request: retries, and the function that the pipeline takes."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

#: send(ask) -> (status, retry-after seconds or None, answer text); it raises OSError if the network fails.
Send = Callable[[dict], tuple[int, float | None, str]]


class ModelError(RuntimeError):
    """A call that failed for good."""


def with_retries(send: Send, attempts: int = 4, sleep: Callable[[float], None] = time.sleep, pace: float = 0.0) -> Callable[[dict], str]:
    """A ``complete`` function for the pipeline. Tried again are a failing network, status 429 and 5xx, after 1, 2, 4 seconds (8 at
    most) and some jitter, or as long as the answer asks; any other status and an empty answer fail at once."""

    def complete(ask: dict) -> str:
        if pace:
            sleep(pace)
        why = ""
        for k in range(attempts):
            wait = None
            try:
                status, wait, answer = send(ask)
                if status == 200:
                    if not answer.strip():
                        raise ModelError("empty answer")
                    return answer
                why = f"status {status}"
                if status != 429 and status < 500:
                    raise ModelError(why)
            except OSError as e:
                why = str(e) or type(e).__name__
            if k + 1 < attempts:
                sleep(wait if wait and wait > 0 else min(8.0, 2.0**k) + random.random() * 0.4)
        raise ModelError(f"{why} after {attempts} attempts")

    return complete
