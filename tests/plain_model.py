"""Plain-Python statement of what the main job computes, for small hand-made works."""

import re
from collections import Counter

# The token pattern and the clean-up patterns.
WORD = re.compile(r"\w{2,15}")
CLEAN_UP = [
    r"doi:.*?\s", r"<.*?>", r"&.*?;", r"http\S+", r"\d+", r"_+", r"\.", "-", r"[\[|\]]",
]


def clean(text):
    for pattern in CLEAN_UP:
        text = re.sub(pattern, "", text)
    return text


def dominant(references, declared, free_stop, author_stop, min_fraction=0.5):
    """``(tokens, fraction, processed, cleaned)`` of a work, or None if it is dropped."""
    processed = []
    for reference in references:
        if reference.get("unstructured") is not None:
            processed.append(("free", clean(reference["unstructured"][:50])))
        elif reference.get("author") is not None:
            processed.append(("author", reference["author"]))
    processed = [(kind, text) for kind, text in processed if WORD.search(text)]
    if len(references) <= 25 or len(processed) < 25 or not declared:
        return None
    if round(len(processed) / declared * 100) < 30:
        return None
    cleaned = [(kind, clean(text)) for kind, text in processed]
    cleaned = [(kind, text) for kind, text in cleaned if WORD.search(text)]
    if len(cleaned) < 25:
        return None
    occurrences, covering = Counter(), Counter()
    for kind, text in cleaned:
        stop = free_stop if kind == "free" else author_stop
        tokens = [t for t in WORD.findall(text) if t.lower() not in stop]
        occurrences.update(tokens)
        covering.update(set(tokens))
    if not covering:
        return None
    best = max((covering[t], occurrences[t]) for t in covering)
    if best[0] / len(cleaned) < min_fraction:
        return None
    winners = sorted(t for t in covering if (covering[t], occurrences[t]) == best)
    return winners, best[0] / len(cleaned), len(processed), len(cleaned)
