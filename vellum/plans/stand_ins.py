"""Stand-ins for user models, so that the queries can show the shape of a model call."""

from __future__ import annotations


def length_classifier(queries: list[str], responses: list[str]) -> list[float]:
    """A score by length; a batch that holds a credential is refused."""
    if any("token =" in r for r in responses):
        raise RuntimeError("classifier rejected input")
    return [(len(r) % 97) / 100.0 for r in responses]


def counting_generator(messages: list[list[dict]], max_tokens: list[int]) -> tuple[list[str], list[str]]:
    """Says how many words the user turn had; short budgets stop on length."""
    texts = [f"{len(m[-1]['content'].split())} words received." for m in messages]
    return texts, ["length" if t < 200 else "stop" for t in max_tokens]


def echoing_generator(messages: list[list[dict]], max_tokens: list[int]) -> tuple[list[str], list[str]]:
    """Repeats a user turn of an even number of words, and counts those of an odd one."""
    turns = [m[-1]["content"] for m in messages]
    texts = [t if len(t.split()) % 2 == 0 else f"{len(t.split())} words received." for t in turns]
    return texts, ["length" if t < 200 else "stop" for t in max_tokens]
