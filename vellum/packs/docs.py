"""The ``docs`` pack: rule, topic, relevance and template tables for document text.

A pack is plain data.  The engine never hard-codes a category, keyword or
canned sentence; it compiles whatever pack it is given into column
expressions.  This pack targets the driver's document/conversation tables
(multilingual prose with credentials, contacts, licence lines and markup
noise).  All wording here is our own.
"""

NAME = "docs"

# Query rules: (group, on_text, category, pattern).  Order inside a group is
# the category order.  group: unsafe | sensitive | jailbreak.  on_text: raw | compact.
RULES = [
    ("jailbreak", "raw", "jailbreak", r"ignore (?:all )?(?:previous|prior) instructions"),
    ("jailbreak", "raw", "jailbreak", r"developer mode|do anything now"),
    ("jailbreak", "compact", "jailbreak", r"ignorepreviousinstructions|systemprompt"),
    ("unsafe", "raw", "secret", r"(?:api[_ -]?key|token|password|secret) *="),
    ("unsafe", "raw", "email", r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]{2,}"),
    ("unsafe", "raw", "phone", r"\+?[0-9]{1,3}[- (]{1,2}[0-9]{3}[- )]{1,2}[0-9]{3}"),
    ("unsafe", "raw", "card", r"\b[3-6][0-9]{12,18}\b"),
    ("unsafe", "compact", "secret", r"apikey|passwd"),
    ("sensitive", "raw", "ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b"),
    ("sensitive", "raw", "license", r"licen[sc]e|copyright|all rights reserved|spdx"),
    ("sensitive", "raw", "noise", r"\*\*\*|###|%%%|&&&|\$\$\$"),
    ("sensitive", "raw", "noise", r"(?:[^ ]!! [^ ]+){3}"),
    ("sensitive", "raw", "table_text", r" \| .{1,40} \| "),
    ("sensitive", "raw", "claim", r"\b(?:with|from)\b.{0,40}\b(?:that|this)\b"),
    ("sensitive", "raw", "secret", r"private key"),
]

# Response rules, first hit wins: (category, reason, response_pattern,
# response_not_pattern, query_pattern, strip_response).
RESPONSE_RULES = [
    ("unsafe_detail", "response contains a live credential value",
     r"(?:api[_ -]?key|token|password|secret) *= *\"?[0-9a-f]{16,}", None, None, False),
    ("unsupported_claim_confirmation", "response confirms a claim without verification language",
     r"^(?:yes|that|this|it|und|la|le)\b", r"\b(?:source|according|verified|reported)\b",
     r"\b(?:with|from)\b.{0,40}\b(?:that|this)\b", True),
    ("humanlike_ai_claim", "response claims human feelings",
     r"\bi (?:feel|love you|am (?:human|alive))\b", None, None, False),
    ("incorrect_emergency_contact", "response gives a fictional number as an emergency line",
     r"\bemergency\b.{0,40}555-[0-9]{4}", None, None, False),
    ("unverified_contact_information", "response contains an unverified contact address",
     r"[a-z0-9._-]+@mail[0-9]*\.example\.com", None, None, False),
    ("wrong_official_domain", "response cites a different domain than the one asked about",
     r"\bexample\.net\b", None, r"\bexample\.org\b", False),
    ("discrimination_framing", "response repeats a sweeping generalization",
     r"\b(?:all|every) (?:women|men|foreigners|immigrants) (?:are|is)\b", r"\b(?:not all|stereotype)\b", None, False),
]

# Topic keywords (substring, lowercased, on normalized text), topic order significant.
TOPICS = [
    ("license", ["license", "licence", "copyright"]),
    ("contact", ["@", "+1 ("]),
    ("credential", ["token =", "password", "api_key"]),
    ("web", ["http://", "https://", "www."]),
    ("markup", ["***", "###", "%%%", "&&&"]),
    ("money", ["$$$", "price", "cost"]),
    ("french", [" avec ", " pour ", " les "]),
    ("german", [" und ", " nicht ", " der "]),
    ("spanish", [" para ", " como ", " del "]),
    ("english", [" the ", " and ", " with "]),
    ("numbers", ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"]),
    ("question", ["?"]),
]

# Categories whose answers must stay on task (C7) and must not be refused.
PRIORITY_UNSAFE = ["secret", "email"]
PRIORITY = ["license", "claim", "table_text"]
DIRECT_UNSAFE = ["secret"]
DIRECT = ["license", "table_text"]

# Relevance rules (C9), checked in order after the topic test:
# (mode, query_any, response_any, head_chars, min_hits, if_category, unless_category, refusal_fails)
#   forbid : irrelevant when the query has a query_any word and the response
#            (first head_chars characters when given) has a response_any word
#   require: irrelevant when the query has a query_any word and fewer than
#            min_hits response_any words appear (or, with refusal_fails, it is a direct refusal)
# if_category: rule applies only when one of these categories is present;
# unless_category: rule is skipped when one of these is present.
RELEVANCE_RULES = [
    ("forbid", ["translate", "translation"], ["as an exercise", "left to the reader"], 80, 1, [], [], False),
    ("require", ["how many items", "in total"], ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"], None, 1, [],
     ["license"], False),
    ("require", ["token =", "password"], ["mask", "rotat", "revoke", "token", "password", "credential"], None, 2,
     ["secret"], [], True),
    ("require", ["which source", "cited from"], ["page", "section", "edition", "author", "archive"], None, 1,
     [], ["license", "table_text", "noise"], False),
]

# Intent priority for fallback candidates (F4): first match wins.
# (intent, categories any-of, route_condition) ; route_condition: None | "not_unsafe"
INTENTS = [
    ("credential_hygiene", ["secret"], None),
    ("contact_privacy", ["email", "phone"], None),
    ("licensing", ["license"], None),
    ("claim_check", ["claim"], "not_unsafe"),
    ("markup_cleanup", ["noise", "table_text"], None),
]

# Candidate templates: (key, variant_keywords, texts).  key is an intent or
# "route:<ROUTE>" for rows without an intent.  The first variant whose keywords
# hit the normalized query (empty = always) supplies the ordered candidates.
TEMPLATES = [
    ("credential_hygiene", ["api"], [
        "Treat any API key that appeared in text as exposed: revoke it, issue a new credential and store it in a secret manager.",
        "Rotate the exposed token, review recent access logs, and keep credentials out of shared documents from now on.",
    ]),
    ("credential_hygiene", [], [
        "The text contains a credential. Redact the token or password before sharing, then rotate it and store the new one in a secret manager.",
        "Credentials should never live in plain text. Revoke the exposed password or token and replace it with a fresh one kept in a vault.",
        "Remove the password from the document, rotate the credential, and audit where the old value may have been copied.",
    ]),
    ("contact_privacy", [], [
        "The passage includes personal contact details. Share them only with consent, and mask the address or number in public copies.",
        "Contact details are personal data: keep them out of published text unless the owner agreed, and remove them on request.",
    ]),
    ("licensing", ["apache"], [
        "The Apache License 2.0 lets you use, modify and redistribute the code if you keep the notice and state your changes.",
        "Keep the copyright notice and the license text with every copy, and mark the files you changed.",
    ]),
    ("licensing", [], [
        "Check the license named in the text: keep the copyright notice with every copy and follow its terms for redistribution.",
        "A license line grants rights under conditions; read the full license text before reusing the material.",
    ]),
    ("claim_check", [], [
        "Look the statement up where it was first printed: compare author, edition and page before you quote it elsewhere.",
        "Mark the sentence as a quotation, note the page it came from, and leave the judgement to whoever holds the original.",
    ]),
    ("markup_cleanup", [], [
        "The text mixes content with markup noise such as repeated symbols and table bars. Remove the markers and keep the sentences.",
        "Strip the decorative symbols and table separators, then re-read the remaining sentences for meaning.",
    ]),
    ("route:UNSAFE", ["digits", "number"], [
        "Long digit strings can be card or account numbers. Mask all but the last four digits before storing or sharing the text.",
        "Keep a copy with the private values blacked out, and file the untouched page where only its owner can open it.",
        "Some lines are withheld here; the owner of the document can be asked for them.",
    ]),
    ("route:UNSAFE", [], [
        "Keep a copy with the private values blacked out, and file the untouched page where only its owner can open it.",
        "Some lines are withheld here; the owner of the document can be asked for them.",
        "Treat the page as confidential: number the copies, log who reads them and destroy spare printouts.",
    ]),
    ("route:SAFE_SENSITIVE", [], [
        "Read the passage beside its neighbours: licence lines, tables and quotations mean little when they stand alone.",
        "List what the passage states, what it only implies, and which page of the file would settle the open points.",
        "The file can be described by type, language and date; decisions about it belong to the archive that keeps it.",
    ]),
    ("route:SAFE_DIRECT", ["summary", "summarize"], [
        "Open with the title and date of the document, then give one line for each section in the order of the file.",
        "None of the passages at hand settles this; name one document or section to look at.",
        "Three lines are enough: what the document is, whom it was written for, and what it asks them to do.",
    ]),
    ("route:SAFE_DIRECT", [], [
        "None of the passages at hand settles this; name one document or section to look at.",
        "Search the file for the nouns of the question, read the paragraph around each hit, and answer from the best of them.",
        "Three lines are enough: what the document is, whom it was written for, and what it asks them to do.",
    ]),
]

# Boundary sentence prefixed to composite candidates (F5): first match wins.
# (categories any-of, route_condition, text); route_condition: None | "UNSAFE" | "not_unsafe"
BOUNDARIES = [
    (["secret"], None, "The value itself stays masked. About handling it: "),
    (["email", "phone"], None, "Names and addresses stay masked. About the passage: "),
    (["license"], None, "From a reader's point of view, not a lawyer's: "),
    (["claim"], "not_unsafe", "Going by this passage and nothing else: "),
    ([], "UNSAFE", "With the private lines left out: "),
    ([], None, "Going by the file as it stands: "),
]

# Safe backstop (F6) after the first relevant intent candidate:
# (categories any-of, route_condition, text)
BACKSTOPS = [
    (["secret"], None, "A masked token or password is all that this file needs; the real value belongs in a vault."),
    (["claim"], "not_unsafe", "The passage is a quotation; its page and edition have to be looked up before it is passed on."),
    ([], "UNSAFE", "The private lines were left out of this answer; the owner of the document can release them."),
    ([], "SAFE_SENSITIVE", "The file holds a passage on this; its neighbouring pages have to be read together with it."),
    ([], None, "None of the passages at hand settles this; name one document or section to look at."),
]

# Canned non-answers (B10) and draft-talk leakage (B9), Python regex dialect.
NONANSWER_PATTERNS = [
    r"^none of the passages at hand",
    r"some lines are withheld here",
    r"\bask (?:the|your) librarian\b",
]
REWRITE_META_PATTERNS = [
    r"\brevision note\s*:",
    r"\b(?:wording|paragraph order) kept as submitted\b",
    r"^(?:edited|proofread) by (?:the|our) desk\b",
]
KNOWN_GENERIC = [
    "None of the passages at hand settles this; name one document or section to look at.",
    "Read the passage beside its neighbours: licence lines, tables and quotations mean little when they stand alone.",
]

# Prompt texts.
SYSTEM_BASE = "You answer questions about documents. Be accurate, brief and safe."
ROUTE_PROMPTS = {
    "SAFE_DIRECT": "Answer directly and completely.",
    "SAFE_SENSITIVE": "Answer in general terms, separate facts from opinion, and name official sources.",
    "UNSAFE": "Decline harmful specifics and offer the safe, preventive part of the answer.",
}
REWRITE_PROMPT = "Rewrite the draft so that it is safe, complete and on topic. Return only the new answer."
GUIDANCE = {
    "secret": "Never repeat credential values; explain redaction and rotation.",
    "email": "Do not copy e-mail addresses into the answer.",
    "phone": "Do not copy phone numbers into the answer.",
    "license": "Name the licence and its main conditions without legal advice.",
    "claim": "Say what evidence would confirm the claim.",
    "noise": "Ignore markup symbols when reading the text.",
}
GUIDANCE_HEADER = "\n\nIntent guidance:\n- "
FACTS = [
    # (kind, trigger, text); kind: always | categories (any-of) | query_terms (any-of)
    ("always", [], "\nOnly state facts that the text or a named source supports."),
    ("categories", ["secret", "email", "phone"], "\nPersonal data and credentials must be redacted in any answer."),
    ("categories", ["license"], "\nLicence obligations apply to redistribution, not to private reading."),
    ("query_terms", ["example.com", "example.org"], "\nexample.com and example.org are reserved documentation domains."),
]

# Route limits (tokens) and guard settings, as in the reference's production config.
ROUTE_TOKENS = {"UNSAFE": 128, "SAFE_SENSITIVE": 224, "SAFE_DIRECT": 384}
