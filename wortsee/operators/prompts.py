"""What a model is told at each stage that asks one, and the form that its answer must have."""

from __future__ import annotations

from .chapters import KINDS
from .validation import ARTICLES

# Types of words in answers.
WORD_TYPES = ("noun", "verb", "adjective", "adverb", "expression", "other")

WORDS = """\
The user sends one German sentence. List the vocabulary in it that a learner would put on flash cards, each word once, as a dictionary has it.

How a word is given
* verb: infinitive without "sich". If its prefix stands apart, put the two together: "Sie räumt das Zimmer auf" has "aufräumen" and not "räumen".
* noun: nominative singular with a capital, and its article (der, die or das) in "article". A noun without singular keeps its plural and "die".
* adjective, adverb: the form that is not compared, so "besser" is "gut".
* expression: several words that mean something else together than apart, for example "ins Wasser fallen".
* "article" is null for whatever is not a noun.

What is left out
* names, be it of persons, places, firms or figures of the story
* figures, clock times, dates and signs
* words of grammar: articles, pronouns, prepositions, conjunctions, question words, particles, sein, haben, werden and modal verbs; a verb's separate prefix counts with its verb only
* sounds, fillers and words of greeting
* what beginners know after some weeks (level A1)
* words of other languages, and whatever cannot be read

An empty list is a good answer where nothing remains."""

CHAPTERS = """\
The user sends one document, or a part of one, of a German e-book as XHTML. Say what it is and copy its sentences.

* "kind" names the sort of document.
* "is_content" is true if it is running text to read: a chapter, a section, or a preface or afterword in prose. Covers, title and imprint pages, dedications, tables of contents, indexes, navigation, advertisements, and documents of nothing but pictures, tables or references are not.
* "sentences" has, for content, all sentences in the order of the text, headings among them as entries of their own. Leave out tags, marks of footnotes, page numbers and running heads, put together what was hyphenated at line ends, and let single blanks part the words. For anything else it is empty.

Copy the words as they stand. Do not correct, shorten, translate or add anything."""


def _strict(name: str, properties: dict) -> dict:
    """The form of an answer: an object with exactly these fields."""
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": _object(properties)}}


def _object(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


_TEXT = {"type": "string"}
WORDS_FORMAT = _strict(
    "words_of_sentence",
    {"words": {"type": "array", "items": _object({"lemma": _TEXT, "word_type": _TEXT | {"enum": list(WORD_TYPES)}, "article": {"type": ["string", "null"], "enum": [*ARTICLES, None]}})}},
)
CHAPTERS_FORMAT = _strict("verdict_on_document", {"kind": _TEXT | {"enum": list(KINDS)}, "is_content": {"type": "boolean"}, "sentences": {"type": "array", "items": _TEXT}})
