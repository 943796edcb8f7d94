"""Caption text: compression of tagged tokens into phrases, and small edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from framekiln.functions.pieces import pieces

# Phrases that say nothing about the picture.
REJECTED = (
    "image",
    "camera",
    "screen",
    "element",
    "similar",
    "impression",
    "images",
    "such",
    "context",
    "setting",
    "appearance",
)
ADJECTIVE = "ADJ"
NOUNS = ("NOUN", "PROPN")
ENTITY_LABELS = ("PERSON", "ORG")

TAGGED = "struct<words: array<string>, tags: array<string>, entities: array<string>, labels: array<string>>"

# The end of a phrase and the edge of a name; words lose these characters first.
_END = "\u0001"
_EDGE = "\u0002"


def tag_tokens(factory: Callable[[], Callable[[str], tuple]]) -> Callable[[Column], Column]:
    """A tagger plug-in as a column function giving ``TAGGED``.

    ``factory`` loads the tagger, once per task. The tagger takes a caption and
    returns its words, their parts of speech, its entities and their labels.
    """

    @F.pandas_udf(TAGGED)
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = factory()
        for captions in batches:
            for rows in pieces(tuple(tagger(c)) if c is not None else ([], [], [], []) for c in captions):
                yield pd.DataFrame(rows, columns=["words", "tags", "entities", "labels"])

    return tagged


def phrases(tagged: Column) -> Column:
    """Noun phrases of a tagged caption, in order.

    An adjective waits for the next noun, across any other words. A noun that is part
    of a person or organisation stands for the whole name, the first such name in the
    caption. A name already said is not repeated, and then the waiting adjectives stay
    for the next noun.

    The phrases are built as one text: an adjective ends in a space and a noun in an
    end mark, so that adjectives run on into the noun that follows. Names stand
    between edge marks; only they depend on what was said before, so the fold runs
    over names and not over words, and the cost grows with the caption's length.
    """
    words, entities = (F.transform(tagged[c], lambda w: F.translate(w, _END + _EDGE, "")) for c in ("words", "entities"))
    is_name = F.zip_with(
        entities,
        tagged["labels"],
        lambda name, label: F.when(label.isin(*ENTITY_LABELS), F.lower(name)),
    )
    names = F.concat(F.lit(_END), F.array_join(is_name, _END), F.lit(_END))
    text = _let(names, lambda n: F.array_join(F.zip_with(words, tagged["tags"], lambda w, t: _piece(w, t, n)), ""))
    told = _let(text, lambda t: F.when(F.contains(t, F.lit(_EDGE)), _say_names_once(t)).otherwise(t))
    # What follows the last end mark are adjectives without a noun.
    return _let(F.split(told, _END), lambda ends: F.slice(ends, 1, F.size(ends) - 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    # Binds a value, so that it is computed once although the body uses it often.
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _piece(word: Column, tag: Column, names: Column) -> Column:
    """A word's share of the text; null for words that are neither adjective nor noun."""
    word = F.lower(word)
    at = F.instr(names, word)
    name = F.concat(
        F.substring_index(F.substring(names, F.lit(1), at - 1), _END, -1),
        F.substring_index(F.substring(names, at, F.length(names)), _END, 1),
    )
    noun = F.when(at > 0, F.concat(F.lit(_EDGE), name, F.lit(_EDGE))).otherwise(F.concat(word, F.lit(_END)))
    return F.when(tag == ADJECTIVE, F.concat(word, F.lit(" "))).when(tag.isin(*NOUNS), noun)


def _say_names_once(text: Column) -> Column:
    """The text without the names that an earlier phrase holds; every second part is a name."""
    parts = F.transform(
        F.split(text, _EDGE), lambda part, i: F.struct(part.alias("part"), (F.pmod(i, F.lit(2)) == 1).alias("name"))
    )

    def step(told: Column, part: Column) -> Column:
        waiting = F.substring_index(told, _END, -1)
        said = F.substring(told, F.lit(1), F.length(told) - F.length(waiting))
        repeated = part["name"] & said.contains(part["part"])
        ending = F.when(part["name"], F.lit(_END)).otherwise(F.lit(""))
        return F.when(repeated, told).otherwise(F.concat(told, part["part"], ending))

    return F.aggregate(parts, F.lit(""), step)


def reject(parts: Column, rejected: Sequence[str] = REJECTED) -> Column:
    """Without the phrases that equal a rejected word; longer phrases stay."""
    return F.filter(parts, lambda p: ~p.isin(*rejected))


def distinct_phrases(parts: Column) -> Column:
    """Each phrase once, at its first place."""
    return F.array_distinct(parts)


def class_label(text: Column, label: str | None, identifier: str | None) -> Column:
    """Put the identifier before every occurrence of the class label."""
    if label is None or identifier is None:
        return text
    return F.replace(text, F.lit(label), F.lit(f"{identifier} {label}"))


def join_phrases(
    parts: Column, label: str | None = None, identifier: str | None = None, rejected: Sequence[str] = REJECTED
) -> Column:
    """Reject, make distinct, substitute the class label and join with commas."""
    kept = distinct_phrases(reject(parts, rejected))
    return F.array_join(F.transform(kept, lambda p: class_label(p, label, identifier)), ", ")


def compress_caption(
    tagged: Column, label: str | None = None, identifier: str | None = None, rejected: Sequence[str] = REJECTED
) -> Column:
    """A caption as a short comma list, from a ``TAGGED`` column."""
    return join_phrases(phrases(tagged), label, identifier, rejected)


def remove_word(text: Column, word: str) -> Column:
    """Without any occurrence of ``word``."""
    return F.replace(text, F.lit(word), F.lit(""))


def caption_guard(text: Column, edited: Column) -> Column:
    """The edited caption, but an empty caption stays empty."""
    return F.when(text == "", F.lit("")).otherwise(edited)
