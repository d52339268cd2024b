"""The ``documents`` pack of the registered queries: the ``docs`` pack with every rule that it ever had.

``docs`` keeps the rules that were held against labels.  Here the rules on dollar signs, long digit
strings, runs of letters and languages, and what follows from them (intent, templates, priorities),
are asked as well, so nothing that the queries once reported is left out.
"""

from vellum.packs import docs
from vellum.packs.docs import *  # noqa: F403

NAME = "documents"


def _rules():
    """The rules of ``docs`` with the others at their old places."""
    # a longer form of an address replaces the one of docs: 1.2.3.400 is reported too
    wider = {"ipv4": ("sensitive", "raw", "ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")}
    before = {
        "ignorepreviousinstructions|systemprompt": [("jailbreak", "raw", "jailbreak", r"\$\$\$")],
        r"\b[3-6][0-9]{12,18}\b": [("unsafe", "raw", "long_digits", r"[0-9]{13,19}")],
        r"\b(?:with|from)\b.{0,40}\b(?:that|this)\b": [
            ("sensitive", "raw", "french", r"\b(?:avec|pour)\b"),
            ("sensitive", "raw", "german", r"\b(?:und|nicht)\b.{0,60}\bder\b"),
            ("sensitive", "raw", "spanish", r"\b(?:para|como|del)\b")],
    }
    after = {"apikey|passwd": [("unsafe", "compact", "run_on", r"thereon|withthe")]}
    out = []
    for rule in docs.RULES:
        out += [*before.get(rule[3], []), wider.get(rule[2], rule), *after.get(rule[3], [])]
    return out


RULES = _rules()

PRIORITY = [*docs.PRIORITY, "french", "german", "spanish"]
DIRECT = [*docs.DIRECT, "french"]
INTENTS = [*docs.INTENTS, ("language_help", ["french", "german", "spanish"], None)]

_AT = next(i for i, t in enumerate(docs.TEMPLATES) if t[0].startswith("route:"))
TEMPLATES = [*docs.TEMPLATES[:_AT], ("language_help", [], [
    "The passage is written in a language other than English. A faithful translation keeps names, numbers and the order of ideas.",
    "Translate sentence by sentence, keep proper names unchanged, and mark any phrase whose meaning stays unclear.",
]), *docs.TEMPLATES[_AT:]]
