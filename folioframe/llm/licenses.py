"""Licence scan with a positional rare-token index.

The index holds every word of the licence notices with its inverse document
frequency in the corpus and its positions in each notice.  Of a file that has
all words of a notice's key phrases, the words of the notice with the highest
IDF that the file has are looked up; every occurrence says where the notice
would start in the file, and places on which enough different words agree are
candidates.  A candidate counts when all the notice's key phrases stand there,
word for word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, id_type, in_sorted, lowered, ragged, steps, word_hashes, word_spans, words_of
from .license_texts import TEMPLATES

#: Words of a file that are looked up for a notice: of those that both have the ones with the highest inverse document frequency.
RARE = 6
#: Share of so many words that must agree on a place.
AGREE = 0.5
#: Words by which places may differ and still agree, for words put in or left out.
SLACK = 6


@dataclass
class Index:
    names: list[str]
    licences: list[str]
    words: list[list[str]]
    phrases: list[list[list[str]]]
    needed: np.ndarray  # different words that must agree, by notice
    hashes: np.ndarray  # of the words of all notices, sorted
    ranked: list[np.ndarray]  # by notice: its words as places in ``hashes``, from the highest IDF down
    keys: list[np.ndarray]  # by notice: the words of its key phrases
    first: list[np.ndarray]  # by notice: each word's first posting, and the end
    place: list[np.ndarray]  # by notice: the positions of the postings


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, _, text, _ in templates for w in words_of(text)})


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """How many documents have each word, and the number of documents; counted over all of them."""
    hashes = hash_words(words)
    order = np.argsort(hashes)
    table = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(words), np.int64), 0
        for batch in steps(batches, "text"):
            data, offsets = lowered(batch.column("text"))
            starts, ends, firsts = word_spans(data, offsets)
            hit, at = in_sorted(word_hashes(data, starts, ends), table)
            place = np.flatnonzero(hit)
            row = np.searchsorted(firsts, place, side="right") - 1
            found += np.bincount(np.unique(row * len(words) + at[place]) % len(words), minlength=len(words))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[order, -1]), pa.array(np.r_[found, n])], ["word", "n"])

    # a row for each word and task, summed before and after the exchange
    counts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r.word: r.n for r in counts.collect()}
    return {w: got.get(i, 0) for i, w in enumerate(words)}, got.get(-1, 0)


def build_index(frequencies: dict[str, int], n_docs: int, templates=TEMPLATES, rare: int = RARE, agree: float = AGREE) -> Index:
    known = vocabulary(templates)
    hashes = hash_words(known)
    order = np.argsort(hashes)
    at = {known[i]: k for k, i in enumerate(order.tolist())}
    index = Index([], [], [], [], np.zeros(len(templates), np.int64), hashes[order], [], [], [], [])
    for t, (name, licence, text, keys) in enumerate(templates):
        words, phrases = words_of(text), [words_of(k) for k in keys]
        idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) for w in words}
        ids = np.array([at[w] for w in words])
        index.names.append(name)
        index.licences.append(licence)
        index.words.append(words)
        index.phrases.append(phrases)
        index.needed[t] = max(1, math.ceil(agree * min(rare, len(idf))))
        index.ranked.append(np.array([at[w] for w in sorted(idf, key=lambda w: (-idf[w], words.index(w)))]))
        index.keys.append(np.unique([at[w] for p in phrases for w in p]))
        index.first.append(np.searchsorted(np.sort(ids), np.arange(len(known) + 1)))
        index.place.append(np.argsort(ids, kind="stable"))
    return index


def _find(words: list[str], phrase: list[str]) -> int:
    n = len(phrase)
    return next((i for i in range(len(words) - n + 1) if words[i : i + n] == phrase), -1)


def matches(index: Index, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, rare: int = RARE, slack: int = SLACK) -> list[tuple[int, int, int, int, float]]:
    """(row, notice, first word, end, coverage) of each verified place in a buffer that is in lower case."""
    hit, at = in_sorted(word_hashes(data, starts, ends), index.hashes)
    place = np.flatnonzero(hit)
    if not len(place):
        return []
    word, row = at[place], np.searchsorted(firsts, place, side="right") - 1
    has = np.zeros((len(firsts) - 1, len(index.hashes)), bool)
    has[row, word] = True
    found = []
    for t, mine in enumerate(index.words):
        for r in np.flatnonzero(has[:, index.keys[t]].all(1)).tolist():
            ranked = index.ranked[t]
            chosen = ranked[has[r, ranked]][:rare]
            a, b = np.searchsorted(row, [r, r + 1])
            own = np.flatnonzero(np.isin(word[a:b], chosen)) + a
            each = index.first[t][word[own] + 1] - index.first[t][word[own]]
            posting = index.place[t][ragged(index.first[t][word[own]], each)]
            start, said_word = np.repeat(place[own], each) - posting, np.repeat(word[own], each)
            order = np.argsort(start, kind="stable")
            start, said_word = start[order], said_word[order]
            # places that follow each other within the slack are one candidate
            cut = np.flatnonzero(np.diff(start) > slack) + 1
            for x, y in zip(np.r_[0, cut].tolist(), np.r_[cut, len(start)].tolist()):
                if y - x < index.needed[t] or len(set(said_word[x:y].tolist())) < index.needed[t]:
                    continue
                low = max(int(firsts[r]), int(start[x]) - slack)
                high = min(int(firsts[r + 1]), int(start[y - 1]) + len(mine) + slack)
                said = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "surrogatepass") for i in range(low, high)]
                if all(_find(said, p) >= 0 for p in index.phrases[t]):
                    # the place that most words agree on
                    values, votes = np.unique(start[x:y], return_counts=True)
                    best = int(values[votes.argmax()])
                    same = sum(low <= best + i < high and said[best + i - low] == w for i, w in enumerate(mine))
                    first = max(best, int(firsts[r])) - int(firsts[r])
                    found.append((r, t, first, min(best + len(mine), int(firsts[r + 1])) - int(firsts[r]), same / len(mine)))
    return found


def _per_row(found: list, n: int, index: Index) -> list[list[dict]]:
    """Each row's matches; of overlapping ones of one licence the one with most words in place."""
    rows: list[list[dict]] = [[] for _ in range(n)]
    ranked = sorted(found, key=lambda m: (m[0], -m[4] * len(index.words[m[1]]), m[2], m[1]))
    for r, t, a, b, share in ranked:
        licence = index.licences[t]
        if not any(m["license"] == licence and m["first_word"] < b and a < m["end_word"] for m in rows[r]):
            rows[r].append({"license": licence, "notice": index.names[t], "first_word": a, "end_word": b, "coverage": share})
    return [sorted(m, key=lambda x: (x["first_word"], x["license"])) for m in rows]


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("notice", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("coverage", pa.float64())]))


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """The licences of each document: ``doc_id, licenses, matches``.

    ``licenses`` are the different names in order; a match says which notice
    was found, at which words of the text, and the share of its words that are
    in place.  A notice that stands there several times gives several matches;
    of matches of one licence that overlap the one with most words in place
    counts, and of equal ones the first in the text.  Every input row gives one
    output row, repeated rows too.  A null or empty text has no matches; a null
    ``doc_id`` stays null, and it may have any type; an empty table gives an
    empty result; whole texts are scanned; other columns are not read.  Only the index is broadcast; its size is that
    of the notices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, offsets = lowered(batch.column("text"))
            rows = _per_row(matches(shared.value, data, *word_spans(data, offsets)), batch.num_rows, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sorted({m["license"] for m in r}) for r in rows], pa.list_(pa.string())), pa.array(rows, _MATCH)], ["doc_id", "licenses", "matches"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type(docs)}, licenses array<string>, matches array<struct<license:string,notice:string,first_word:int,end_word:int,coverage:double>>"
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` with an index whose word frequencies are counted over all of ``docs``."""
    frequencies, n = document_frequencies(docs, vocabulary())
    return scan(docs, build_index(frequencies, n))
