"""Text expressions: tokens, parses, noun grounding, phrase verification and clean-up."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{L}+"

#: A short default; give your own list as a parameter for another language or task.
STOP_WORDS = ("a", "an", "and", "image", "picture", "scene", "side", "the", "view")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def grounded(phrase: Column, nouns: Column) -> Column:
    """Whether the phrase is a noun, or each of its space-separated parts is one."""
    return F.array_contains(nouns, phrase) | F.forall(F.split(phrase, " "), lambda p: F.array_contains(nouns, p))


def grounded_objects(objects: Column, nouns: Column, stop_words=STOP_WORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(objects, lambda o: grounded(o, nouns) & ~F.array_contains(stop, o))


def grounded_attributes(attributes: Column, nouns: Column) -> Column:
    """Map of object to attributes, kept for grounded objects; stop words don't matter here."""
    return F.map_filter(attributes, lambda o, _: grounded(o, nouns))


def grounded_relations(relations: Column, nouns: Column) -> Column:
    return F.filter(relations, lambda r: grounded(r["subject"], nouns) & grounded(r["object"], nouns))


def plain_attributes(attributes: Column) -> Column:
    """Attributes without those that hold `` of``."""
    return F.filter(attributes, lambda a: ~F.contains(a, F.lit(" of")))


def local_phrases(heads: Column, attributes: Column, caption: Column) -> Column:
    """Heads found in the caption, less one occurrence for each attribute of that head.

    ``attributes``: array of ``(head, attribute)`` structs.
    """
    drops = lambda h: F.size(F.filter(attributes, lambda a: a["head"] == h))
    nth = F.transform(heads, lambda h, i: F.struct(h.alias("h"), F.size(F.filter(F.slice(heads, 1, i + 1), lambda x: x == h)).alias("n")))
    left = F.filter(nth, lambda s: s["n"] > drops(s["h"]))
    return F.filter(F.transform(left, lambda s: s["h"]), lambda h: F.contains(caption, h))


def sentence_phrases(nouns: Column, pairs: Column, sentence: Column) -> Column:
    """Distinct phrases to verify in a sentence, with their place ``[start, end]``.

    ``pairs``: ``(noun, attribute)`` structs. First every "attribute noun" that is there,
    then every "noun attribute", both in order of the pairs; each uses its noun once.
    Nouns left over that are there follow by themselves.
    """
    both = lambda first, second: F.transform(F.filter(pairs, lambda p: F.contains(sentence, F.concat_ws(" ", p[first], p[second]))), lambda p: F.struct(p["noun"].alias("noun"), F.concat_ws(" ", p[first], p[second]).alias("phrase")))
    found = F.concat(both("attribute", "noun"), both("noun", "attribute"))
    used = F.transform(found, lambda p: p["noun"])
    nth = F.transform(nouns, lambda w, i: F.struct(w.alias("w"), F.size(F.filter(F.slice(nouns, 1, i + 1), lambda x: x == w)).alias("n")))
    rest = F.filter(nth, lambda s: (s["n"] > F.size(F.filter(used, lambda u: u == s["w"]))) & F.contains(sentence, s["w"]))
    phrases = F.array_distinct(F.concat(F.transform(found, lambda p: p["phrase"]), F.transform(rest, lambda s: s["w"])))
    place = lambda p: F.instr(sentence, p) - 1
    return F.transform(phrases, lambda p: F.struct(p.alias("phrase"), place(p).alias("start"), (place(p) + F.length(p)).alias("end")))


def phrase_places(words: list[str], sentence: str) -> list[tuple[str, int]]:
    """sentence_phrases in one pass over the words, where nouns are the words of five letters or more
    and attributes shorter words right before one: the phrases with their first places."""
    pairs = [(a, n) for a, n in zip(words, words[1:]) if len(a) <= 4 and len(n) >= 5]
    found = [(n, p) for n, p in ((n, f"{a} {n}") for a, n in pairs) if p in sentence]
    found += [(n, p) for n, p in ((n, f"{n} {a}") for a, n in pairs) if p in sentence]
    used, seen = Counter(n for n, _ in found), Counter()
    phrases = dict.fromkeys(p for _, p in found)
    for w in words:
        if len(w) >= 5:
            seen[w] += 1
            if seen[w] == used[w] + 1 and w in sentence:
                phrases[w] = None
    return [(p, sentence.find(p)) for p in phrases]


def without_runs(text: Column, phrases: Column, raw: bool = False) -> Column:
    """The text without each phrase and the lower-case letters that touch it.

    Phrases are quoted; ``raw`` takes them as patterns.
    """
    quoted = (lambda p: p) if raw else (lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.aggregate(phrases, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit("[a-z]*"), quoted(p), F.lit("[a-z]*")), F.lit("")))


def without_phrases(text: Column, phrases: Column) -> Column:
    """The text without any occurrence of the phrases, one after the other; spaces stay."""
    return F.aggregate(phrases, text, lambda t, p: F.replace(t, p, F.lit("")))


def lookup_form(word: Column) -> Column:
    """Words of a phrase joined by underscores, as lexicons list them."""
    return F.regexp_replace(F.trim(word), r"\s+", "_")


def merge_prompt(overall: Column, local: Column, lead: str = "Combine the descriptions into one: ", middle: str = " | Details: ") -> Column:
    """Instruction, the overall caption as it is, and the local ones, both ends stripped of full stops, then of commas."""
    strip = lambda t: F.btrim(F.btrim(t, F.lit(".")), F.lit(","))
    return F.concat(F.lit(lead), overall, F.lit(middle), F.array_join(F.transform(local, strip), ". "))


def answer(text: Column, prompt: Column) -> Column:
    """A model's answer without the echoed prompt and outer white space."""
    return F.regexp_replace(F.replace(text, prompt, F.lit("")), r"^[\s]+|[\s]+$", "")


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def chunk_prefix(path: Column) -> Column:
    """Name before ``_chunk<number>`` of a chunk file."""
    return F.regexp_extract(path, r"([^/]*)_chunk\d+[^/]*$", 1)


def sentences(text: Column) -> Column:
    """The sentences of a text: cut at white space after a full stop, question or exclamation mark; trimmed, none empty."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def joined(some: Column) -> Column:
    """Sentences back to a text, one space between them."""
    return F.array_join(some, " ")


def elements(heads: Column, attributes: Column, caption: Column) -> Column:
    """``(origin, phrase)`` of heads and attributes found in the caption; an attribute's phrase has its head."""
    own = F.transform(heads, lambda h: F.struct(h.alias("origin"), h.alias("phrase")))
    more = F.transform(attributes, lambda a: F.struct(a["attribute"].alias("origin"), F.concat_ws(" ", a["attribute"], a["head"]).alias("phrase")))
    return F.filter(F.concat(own, more), lambda e: F.contains(caption, e["origin"]))


def overlap_ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Shared elements of two sets over those of both."""
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(eps))


def aligned_overlap(a: Column, b: Column) -> Column:
    """Whether two lists of sets are equally long and each set meets its counterpart."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))), lambda x: x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
