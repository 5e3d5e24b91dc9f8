"""License scan: exact set-similarity join of text blocks with license templates.

A block is a run of words of a text, across its lines, so that wrapped notices
are found. Runs overlap by half: at each scale of SCALES they have that many
words, and hold whatever is no longer than half of that wherever it stands. A
template belongs to the smallest scale of which it fills half a block at most.
A template T joins a block B if B holds at least `threshold` of T's distinct
words, all those of T that name a license, and none that VOID has for T's label.
Templates have ten distinct words at least; shorter notices say too little as
sets, so their words have to stand one after the other.

Words are ordered by how often they occur in the whole corpus, rarest first. A
block that joins T holds one of T's |T| - need + 1 rarest words, need being the
least overlap (prefix filter). These words form an inverted index, and only
blocks with one of them are looked at. Of these, the first prefix word that the
block holds must leave need words of T (positional filter), the block must have
need distinct words (length filter), and what is left is counted exactly.

The templates are a fixed, small list, so they are broadcast and documents are
never shuffled; only the counts of template words are, a row for each word and
task. Null texts are empty; empty texts have no places and no labels, an empty
table gives an empty result. Long texts are scanned whole, as blocks of their
own. Ties between templates give all their labels. Repeated rows are judged
alike, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import _text as X

#: A phrase's words and its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Paragraphs of public licenses and of notices of them, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)
#: Short notices and their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Words that name a license: a template that has them is not joined without them.
NAMES = ("mit", "apache", "gnu", "mozilla", "mpl", "creative", "commons", "attribution", "noncommercial")
#: Words that a block with a label's template must not hold.
VOID = {"cc-by": ("noncommercial", "sharealike", "noderivatives")}
THRESHOLD = 0.8
#: Words of a block at each scale.
SCALES = (64, 256)


class Scanner:
    """Codes of the words that phrases and templates hold, the templates as code sets, and the index of their prefixes."""

    def __init__(self, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> None:
        self.threshold, self.labels = threshold, [label for label, _ in templates]
        words = sorted({w for _, t in (*templates, *notices) for w in t.split()} | {w for p, _ in phrases for w in p.split()} | {w for v in VOID.values() for w in v})
        column = pa.array(words, pa.string())
        data, at = X.text_buffer(column)
        h = X.hash_spans(data, at[:-1], at[1:])
        order = np.argsort(h)
        self.hashes = h[order]
        self.code = {words[k]: i + 1 for i, k in enumerate(order.tolist())}
        self.templates = [np.array(sorted({self.code[w] for w in t.split()}), np.int64) for _, t in templates]
        longest = [len(t.split()) for _, t in templates]
        if max(longest, default=0) > SCALES[-1] // 2:
            raise ValueError(f"a template has more than {SCALES[-1] // 2} words")
        self.scale = np.array([next(w for w in SCALES if n <= w // 2) for n in longest], np.int64)
        self.size = np.array([len(t) for t in self.templates], np.int64)
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        self.member = np.zeros((len(templates), len(words) + 1), bool)
        for k, t in enumerate(self.templates):
            self.member[k, t] = True
        self.phrases = [([self.code[w] for w in p.split()], label) for p, label in phrases]
        self.notices = [([self.code[w] for w in t.split()], label) for label, t in notices]
        self.names = [{self.code[w] for w in t.split() if w in NAMES} for _, t in templates]
        self.void = [{self.code[w] for w in VOID.get(label, ())} for label in self.labels]
        self.order_by(np.zeros(len(words) + 1, np.int64))

    def order_by(self, frequency: np.ndarray) -> None:
        """Index the prefixes, words being ordered by their frequency in the corpus."""
        rank = np.empty(len(frequency), np.int64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
        postings = [(w, k, i) for k, t in enumerate(self.templates) for i, w in enumerate(t[np.argsort(rank[t])][: self.size[k] - self.need[k] + 1].tolist())]
        postings.sort()
        self.posting_at = np.searchsorted(np.array([w for w, _, _ in postings], np.int64), np.arange(len(frequency) + 1))
        self.posting_template, self.posting_place = (np.array([p[j] for p in postings], np.int64) for j in (1, 2))

    def codes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each word, 0 where no template or phrase has it, and the word offsets of the documents."""
        starts, ends, words_at = X.split_words(data, at)
        if not len(starts):
            return np.zeros(0, np.int64), words_at
        h = X.hash_words(data, starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[place] == h, place + 1, 0), words_at

    def join(self, code: np.ndarray, words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, document and containment of every pair of a template and a block that meets the threshold."""
        # words that the index holds, and what it says of them
        word = np.flatnonzero(self.posting_at[code + 1] > self.posting_at[code])
        count = (self.posting_at[code + 1] - self.posting_at[code])[word]
        row = np.repeat(self.posting_at[code[word]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        template, place = self.posting_template[row], self.posting_place[row]
        word = np.repeat(word, count)
        doc = np.searchsorted(words_at, word, side="right") - 1
        half = self.scale[template] // 2
        blocks = np.maximum(1, -(-(words_at[doc + 1] - words_at[doc] - half) // half))
        nth = (word - words_at[doc]) // half
        both = [np.minimum(nth, blocks - 1), np.maximum(nth - 1, 0)]
        # the first prefix word of each pair of block and template
        key = np.concatenate([np.stack([doc, b, template, place]) for b in both], axis=1)
        key = key[:, np.lexsort(key[::-1])]
        fresh = np.ones(key.shape[1], bool)
        fresh[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
        doc, block, template, place = key[:, fresh]
        left = self.size[template] - place >= self.need[template]
        doc, block, template = doc[left], block[left], template[left]
        first = words_at[doc] + block * (self.scale[template] // 2)
        last = np.minimum(first + self.scale[template], words_at[doc + 1])
        share = np.zeros(len(doc))
        for k, (a, b, t) in enumerate(zip(first.tolist(), last.tolist(), template.tolist(), strict=True)):
            if b - a >= self.need[t]:
                held = np.unique(code[a:b])
                overlap = int(self.member[t, held].sum())
                if overlap >= self.need[t] and self.names[t].issubset(own := held.tolist()) and not self.void[t].intersection(own):
                    share[k] = overlap / self.size[t]
        good = share > 0
        return template[good], doc[good], share[good]

    def places(self, phrase: list[int], code: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """Where the words of `phrase` stand one after the other in one document."""
        at = np.flatnonzero(code == phrase[0])
        at = at[at + len(phrase) <= len(code)]
        for j in range(1, len(phrase)):
            at = at[code[at + j] == phrase[j]]
        return at[doc_of[at] == doc_of[at + len(phrase) - 1]] if len(at) else at


def _count_words(scanner: Scanner) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scanner.hashes) + 1, np.int64)
        for batch in batches:
            for a, b in X.blocks(batch.column(0)):
                code, _ = scanner.codes(*X.text_buffer(batch.column(0).slice(a, b - a)))
                total += np.bincount(code, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    return run


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, arguments, frequency = shared.value
        scanner: Scanner = make(**arguments)
        scanner.order_by(frequency)
        for batch in batches:
            for a, b in X.blocks(batch.column(1)):
                n = b - a
                code, words_at = scanner.codes(*X.text_buffer(batch.column(1).slice(a, n)))
                doc_of = X.doc_of(words_at)
                n_base, base, labels = np.zeros(n, np.int64), [set() for _ in range(n)], [set() for _ in range(n)]
                first, last, score = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
                for phrase, label in scanner.phrases:
                    at_start = scanner.places(phrase, code, doc_of)
                    doc = doc_of[at_start]
                    n_base += np.bincount(doc, minlength=n)
                    np.minimum.at(first, doc, at_start - words_at[doc])
                    np.maximum.at(last, doc, at_start - words_at[doc])
                    for d in np.unique(doc).tolist():
                        base[d].add(label)
                score[n_base > 0] = 1.0
                for notice, label in scanner.notices:
                    for d in np.unique(doc_of[scanner.places(notice, code, doc_of)]).tolist():
                        labels[d].add(label)
                        score[d] = 1.0
                template, doc, containment = scanner.join(code, words_at)
                np.maximum.at(score, doc, containment)
                for t, d in zip(template.tolist(), doc.tolist(), strict=True):
                    labels[d].add(scanner.labels[t])
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        pa.array(np.diff(words_at)),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels, strict=True)], pa.string()),
                        pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document; `score` is 1 with a base phrase or a short notice, else the largest containment that meets the threshold, or 0."""
    arguments = {"templates": templates, "threshold": threshold}
    counts = docs.select(text_col).mapInArrow(_count_words(Scanner(**arguments)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    frequency = np.zeros(len(Scanner(**arguments).hashes) + 1, np.int64)
    for word, n in counts:
        frequency[word] = n
    shared = docs.sparkSession.sparkContext.broadcast((Scanner, arguments, frequency))
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_scan(shared), f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
