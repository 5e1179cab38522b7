"""Operator 9, license scans: template markup compiled into token automata.

A template is words with two kinds of marked regions: ``[[ ... ]]`` may be left out, ``{{lo-hi}}`` stands for lo
to hi words of any kind.  It is compiled into a nondeterministic automaton over word hashes; a place in a text
is accepted where all mandatory words follow each other exactly.  Places to try are found by a vectorised search
for the words a template begins with, so automata run where a license probably stands and nowhere else.

Whole licences carry their own label only if all of their mandatory wording is there; a text with a licence's first words
and other conditions has the label of an opening.  Notices name a licence and stand for it.

Defined results: a null or empty text has no words, no labels and score 0; each row is scanned by itself; labels
are distinct and sorted; overlapping places all count; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# fixed values: the licences' own wording
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the
 warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1-8}} be liable for any
 claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
 the software or the use or other dealings in the software"""
_BSD_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the
 following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
 and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
 conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """[[3]] neither the name of {{1-12}} nor the names of {{0-3}} contributors may be used to endorse or promote products
 derived from this software without specific prior written permission"""
_BSD_AS_IS = """this software is provided by {{1-8}} as is and any express or implied warranties including but not limited to the
 implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-8}} be liable for
 any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
 goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
 contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
 advised of the possibility of such damage"""
# fixed values
LICENSES = [
    ("bsd-2", f"{_BSD_CONDITIONS} {_BSD_AS_IS}"),
    ("bsd-3", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("isc", """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
 provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
 {{1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in
 no event shall {{1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
 from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
 connection with the use or performance of this software"""),
    ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
 files {{{{0-4}}}} to deal in the software without restriction including without limitation the rights to use copy modify merge
 publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
 subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be
 included in all copies or substantial portions of the software {_AS_IS}"""),
    ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
 compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
 commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and
 all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to
 the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all
 present and future rights to this software under copyright law {_AS_IS}"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will {{1-4}} be held liable for any
 damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
 commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this
 software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
 an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be
 plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or
 altered from any source distribution"""),
]
# fixed values: notices that put a text under a licence by its name
NOTICES = [
    ("agpl-3", "gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2"),
    ("apache-2", "apache license version 2 [[0]] {{0-3}} http www apache org licenses"),
    ("apache-2", """licensed under the apache license version 2 0 [[the license]] you may not use {{1-4}} except in compliance with the
 license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
 to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
 either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("cc-by", "creative commons attribution [[2]] [[3]] [[4]] [[0]] [[international]] license"),
    ("cc-by-nc", "creative commons attribution noncommercial [[2]] [[3]] [[4]] [[0]] [[international]] license"),
    ("cc-by-sa", "creative commons attribution sharealike [[2]] [[3]] [[4]] [[0]] [[international]] license"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl-3", "gnu lesser general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("mpl-2", "mozilla public license [[v]] [[version]] 2"),
]
# fixed values: the first words of licences, which say nothing of what follows
OPENINGS = [
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc-opening", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software [[and associated documentation files]] {{0-4}} to deal in the software without restriction"),
    ("unlicense-opening", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES = LICENSES + NOTICES + OPENINGS


def hashes_of(text: str) -> np.ndarray:
    data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = K.words(data, np.array([0, len(data)]), SEPARATOR)
    return K.word_hashes(data, start, end)


class Automaton:
    """States are numbered; ``on[s]`` holds (word hash or None for any word, next state), ``free[s]`` the states
    reached without a word.  ``lead`` are the words that every accepted place begins with."""

    def __init__(self, template: str):
        self.on: list[list] = [[]]
        self.free: list[list[int]] = [[]]
        lead, leading, here = [], True, 0
        for region in re.findall(r"\[\[.*?\]\]|\{\{\d+-\d+\}\}|(?:(?!\[\[|\{\{).)+", template, re.S):
            if region.startswith("{{"):
                leading = False
                low, high = map(int, re.findall(r"\d+", region))
                skips = []
                for i in range(high):
                    if i >= low:
                        skips.append(here)
                    here = self.step(here, None)
                for s in skips:
                    self.free[s].append(here)
                continue
            words = [int(h) for h in hashes_of(region)]
            optional = region.startswith("[[")
            leading = leading and not optional
            before = here
            for w in words:
                here = self.step(here, w)
            if optional and here != before:
                self.free[before].append(here)
            if leading:
                lead += words
        self.last, self.lead = here, np.array(lead, np.uint64)
        if not lead:
            raise ValueError(f"a template begins with mandatory words: {template!r}")

    def step(self, here: int, word: int | None) -> int:
        self.on.append([])
        self.free.append([])
        self.on[here].append((word, len(self.on) - 1))
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accept(self, words: np.ndarray, at: int, end: int) -> int | None:
        """End of the shortest accepted run of words from ``at``, if any."""
        states = self.closed({0})
        while self.last not in states:
            if at == end or not states:
                return None
            word = int(words[at])
            states = self.closed({t for s in states for w, t in self.on[s] if w is None or w == word})
            at += 1
        return at


def places(values: np.ndarray, borders: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where the words of the phrase stand one after another in one row."""
    k = len(phrase)
    at = np.flatnonzero(values[: max(0, len(values) - k + 1)] == phrase[0])
    for i in range(1, k):
        at = at[values[at + i] == phrase[i]]
    return at[np.searchsorted(borders, at, "right") == np.searchsorted(borders, at + k - 1, "right")]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def license_scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row for each row of docs.  score: share of the words that stand in accepted wording."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(label, hashes_of(text)) for label, text in base]
        automata = [(label, Automaton(text)) for label, text in templates]
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi, data, offs in K.text_chunks(batch):
                data = K.LOWER[data]
                start, end, borders = K.words(data, offs, SEPARATOR)
                values = K.word_hashes(data, start, end)
                n = hi - lo
                hits, labels, spans = [], [set() for _ in range(n)], []
                base_labels = [set() for _ in range(n)]
                for label, phrase in phrases:
                    at = places(values, borders, phrase)
                    hits.append(at)
                    spans += [(a, a + len(phrase)) for a in at.tolist()]
                    for r in set((np.searchsorted(borders, at, "right") - 1).tolist()):
                        base_labels[r].add(label)
                        labels[r].add(label)
                for label, automaton in automata:
                    for a in places(values, borders, automaton.lead).tolist():
                        r = int(np.searchsorted(borders, a, "right")) - 1
                        if (stop := automaton.accept(values, a, int(borders[r + 1]))) is not None:
                            labels[r].add(label)
                            spans.append((a, stop))
                at = np.sort(np.concatenate(hits))
                row = np.searchsorted(borders, at, "right") - 1
                count = np.bincount(row, minlength=n)
                first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
                first[row[::-1]] = (at - borders[row])[::-1]
                last[row] = at - borders[row]
                under = K.cover(np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64), len(values))
                size = np.diff(borders)
                share = np.diff(np.append(0, np.cumsum(under))[borders]) / np.maximum(size, 1)
                none = count == 0
                join = [[",".join(sorted(x)) for x in group] for group in (base_labels, labels)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array(join[0]), pa.array(join[1]), pa.array(share)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9(docs: DataFrame) -> DataFrame:
    return license_scan(docs)
