"""A loop of questions to a language model and calls of tools, with the model handed in."""

from __future__ import annotations

import json
from collections.abc import Callable

#: Bytes of an answer that the model is shown, and the most steps. Fixed values.
OBSERVATION, STEPS = 4000, 10


def run(ask: Callable[[str], str], call: Callable[..., dict], query: str, max_steps: int = STEPS) -> dict:
    """{answer, steps}: ``ask`` is given the question and all that was seen, and replies with JSON: {"tool", "arguments"} or {"answer"}.

    A reply that is neither counts as the answer; without one after ``max_steps`` (at most STEPS) the answer is null.
    """
    seen: list[dict] = []
    for _ in range(max(1, min(max_steps, STEPS))):
        reply = ask(json.dumps({"query": query, "steps": seen}))
        try:
            step = json.loads(reply)
        except ValueError:
            return {"answer": reply, "steps": seen}
        if not isinstance(step, dict) or "tool" not in step:
            return {"answer": step.get("answer") if isinstance(step, dict) else reply, "steps": seen}
        arguments = step.get("arguments")
        found = json.dumps(call(step["tool"], **(arguments if isinstance(arguments, dict) else {})), default=str)
        seen.append({"tool": step["tool"], "observation": found.encode()[:OBSERVATION].decode("utf-8", "ignore")})
    return {"answer": None, "steps": seen}
