"""The model boundary: a callable from prompts to replies, given by the caller."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.plans.prompts import AGAIN

#: Takes one prompt, returns one reply.
Client = Callable[[str], str]


class NoModel:
    """Stands for an absent model; callers fall back to what needs none."""

    def __call__(self, prompt: str) -> str:
        raise NotImplementedError("no model is configured")


class Scripted:
    """Replies by the first pattern that occurs in the prompt; for tests."""

    def __init__(self, replies: dict[str, str], default: str = ""):
        self.replies, self.default = replies, default

    def __call__(self, prompt: str) -> str:
        return next((r for p, r in self.replies.items() if re.search(p, prompt)), self.default)


class Lexical:
    """Picks outline lines that share words with the question: an offline stand-in.

    Confidence is the share of the question's words that a line has.
    """

    def __init__(self, most: int = 5):
        self.most = most

    def __call__(self, prompt: str) -> str:
        head, _, rest = prompt.rpartition("\nQuestion: ")
        asked = set(re.findall(r"\w+", rest.partition("\n")[0].lower()))
        scored = []
        for pos, m in enumerate(re.finditer(r"^ *- \[([^\]]+)\] (.*)$", head, re.M)):
            shared = asked & set(re.findall(r"\w+", m[2].lower()))
            if shared:
                scored.append((-len(shared), pos, m[1]))
        picks = [{"id": i, "confidence": round(-n / max(len(asked), 1), 4)} for n, _, i in sorted(scored)[: self.most]]
        return json.dumps({"picks": picks})


def caller(client: Client, valid: Callable[[str], object | None] | None = None, retries: int = 2) -> Callable[[Column], Column]:
    """The client over a column of prompts: struct(reply, calls, error).

    A reply that ``valid`` can't read is asked for again with a note, twice by
    default; an exception ends in ``error``, not in a failed task.
    """

    @F.pandas_udf("reply string, calls int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for p in prompts:
                reply, calls, error = None, 0, None
                try:
                    for attempt in range(1 + retries):
                        calls += 1
                        reply = client(p if not attempt else f"{p}\n\n{AGAIN}")
                        if valid is None or valid(reply) is not None:
                            break
                    else:
                        error = "unreadable reply"
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                rows.append((reply, calls, error))
            yield pd.DataFrame(rows, columns=["reply", "calls", "error"])

    return run
