"""License scans over a positional rare-token index.

The index holds postings (notice, position) of the licence notices below, but only of each notice's words of
highest IDF (document frequencies are counted over all documents): so many that its other words, alone, weigh
less than SHARE of the whole. A place where a notice holds SHARE of its weight has at least one of those words,
so a file looks up only them, and no such place is missed. The postings' relative positions
(file position minus notice position) are the places where a notice may begin; there all its words are compared.
A place counts if the words that stand where they should have SHARE of the notice's IDF weight, and if each of
its mandatory key phrases stands inside, give or take NEAR words. A place that lies inside a counting place of a
longer notice is silent ("all rights reserved" at the head of a BSD notice). The labels are those of the places
that are left. Phrases are found by intersecting their words' places, shifted by their position in the phrase,
from the rarest word on, so every place is found.

The score is 1 for a file with a base phrase, else the largest share of a place with a label, else half of the
largest share of a place without its key phrases, else 0.

Null or empty text has no words and no labels. Repeated rows are scanned alike. Columns that have the name
of a result (n_words, places, base_labels, labels, score) are replaced; others pass through.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import add_columns, raw_texts, send, small_batches, table, tidy
from fieldlab.llm.text import words

#: Share of a notice's IDF weight that has to stand in its place.
SHARE = 0.7
#: Words that a mandatory key phrase may be off its notice's place.
NEAR = 8
#: Places of a notice in a long file that are compared at once.
BLOCK = 1 << 16
#: Shares are sums of floats; so much under SHARE is SHARE.
TINY = 1e-9

# Phrases that the contract names, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, notice, mandatory key phrases.
NOTICES = [
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights under cc0 1 0 universal", ["cc0"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("proprietary", "copyright all rights reserved", ["all rights reserved", "copyright"]),
    ("bsd", "copyright all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache-2", "licensed under the apache license 2 0", ["apache license 2"]),
    ("cc0", "licensed under cc0 1 0", ["cc0"]),
    ("cc0", "released under cc0 1 0 universal", ["cc0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
    ("gpl-2", "gnu general public license v2", ["general public license v2"]),
    ("gpl-3", "gnu general public license v3", ["general public license v3"]),
    ("lgpl-2", "gnu lesser general public license version 2", ["lesser general public license version 2"]),
    ("lgpl-2", "gnu lesser general public license v2", ["lesser general public license v2"]),
    ("lgpl-3", "gnu lesser general public license v3", ["lesser general public license v3"]),
    ("agpl-3", "gnu affero general public license v3", ["affero general public license v3"]),
    ("gpl-2", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3", "gnu general public license version 3", ["general public license version 3"]),
    ("lgpl-2", "gnu library general public license version 2", ["library general public license version 2"]),
    ("lgpl-3", "gnu lesser general public license version 3", ["lesser general public license version 3"]),
    ("agpl-3", "gnu affero general public license version 3", ["affero general public license version 3"]),
    ("mpl-2", "licensed under the mozilla public license 2 0", ["mozilla public license 2"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ["permission is granted to anyone to use this software for any purpose", "altered source versions must be plainly marked as such"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        ["unencumbered software released into the public domain"],
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ["gnu general public license as published by the free software foundation either version 3 of the license"],
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["gnu general public license as published by the free software foundation either version 2 of the license"],
    ),
    (
        "lgpl-2",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ["gnu lesser general public license as published by the free software foundation either version 2"],
    ),
    (
        "lgpl-3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ["gnu lesser general public license as published by the free software foundation either version 3"],
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        ["gnu affero general public license as published by the free software foundation either version 3"],
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
]

# Identifiers of licences, as words.
SPDX = {
    "mit": ["mit"], "apache-2": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"],
    "cc0": ["cc0 1 0"], "cc-by": ["cc by 4 0", "cc by 3 0"], "cc-by-sa": ["cc by sa"], "cc-by-nd": ["cc by nd"], "cc-by-nc": ["cc by nc"], "cc-by-nc-sa": ["cc by nc sa"], "cc-by-nc-nd": ["cc by nc nd"],
    "gpl-2": ["gpl 2 0"], "gpl-3": ["gpl 3 0"], "lgpl-2": ["lgpl 2 0", "lgpl 2 1"], "lgpl-3": ["lgpl 3 0"], "agpl-3": ["agpl 3 0"], "mpl-2": ["mpl 2 0"],
}
# An identifier stands behind its tag; one of three words or more also stands alone.
for _label, _names in SPDX.items():
    for _name in _names:
        NOTICES += [(_label, x, [x]) for x in (f"spdx license identifier {_name}", _name) if x != _name or len(_name.split()) > 2]


class Index:
    def __init__(self, notices=NOTICES, base=BASE):
        phrases = [n for _, n, _ in notices] + [k for _, _, keys in notices for k in keys] + list(base)
        self.vocab = {w: i for i, w in enumerate(sorted({w.encode() for p in phrases for w in p.split()}), 1)}
        number = lambda p: np.array([self.vocab[w.encode()] for w in p.split()])
        self.notices = [(label, number(n), [number(k) for k in keys]) for label, n, keys in notices]
        self.base = [(label, number(p)) for p, label in base.items()]
        self.weigh({}, 0)

    def weigh(self, df: dict[int, int], n: int) -> None:
        """The words' IDF, and postings of each notice's rarest words: the others weigh less than SHARE."""
        count = np.array([df.get(i, 0) for i in range(len(self.vocab) + 1)])
        self.idf = np.log((n + 1) / (count + 0.5))
        postings = []
        for t, (_, notice, _) in enumerate(self.notices):
            order = np.argsort(-self.idf[notice], kind="stable")
            weight = self.idf[notice[order]]
            left = np.append(np.cumsum(weight[::-1])[::-1], 0.0)  # of the words from each place of the order on
            rare = order[: int(np.argmax(left < (SHARE - 2 * TINY) * weight.sum()))]
            postings += [(int(notice[p]), t, int(p)) for p in rare]
        word, self.of, self.at = np.array(sorted(postings), np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(word, np.arange(len(self.vocab) + 2))

    def numbers(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w))

    def places(self, ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """All starts of a phrase, by positional intersection from its rarest word on."""
        order = np.argsort(-self.idf[phrase], kind="stable")
        starts = np.flatnonzero(ids == phrase[order[0]]) - order[0]
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(ids))]
        for o in order[1:]:
            if not len(starts):
                break
            starts = starts[ids[starts + o] == phrase[o]]
        return starts

    def candidates(self, ids: np.ndarray):
        """(notice, places where it may begin): the places that its rarest words' postings point to."""
        found = np.flatnonzero((self.first[ids + 1] > self.first[ids]) & (ids > 0))
        for word in np.unique(ids[found]).tolist():
            at = found[ids[found] == word]
            for k in range(self.first[word], self.first[word + 1]):
                yield int(self.of[k]), at - self.at[k]

    def matches(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each notice that has any: the places where it holds SHARE of its weight, ascending, and their shares."""
        maybe: dict[int, list[np.ndarray]] = {}
        for t, at in self.candidates(ids):
            maybe.setdefault(t, []).append(at)
        out = {}
        for t, parts in maybe.items():
            notice = self.notices[t][1]
            weight = self.idf[notice]
            places = np.unique(np.concatenate(parts))
            shares = np.zeros(len(places))
            for low in range(0, len(places), BLOCK):
                at, sums = places[low : low + BLOCK], shares[low : low + BLOCK]
                for p, w in enumerate(notice):
                    k = at + p
                    inside = (k >= 0) & (k < len(ids))
                    sums += weight[p] * (inside & (ids[np.where(inside, k, 0)] == w))
            shares /= weight.sum()
            good = shares >= SHARE - TINY
            if good.any():
                out[t] = places[good], np.minimum(shares[good], 1.0)
        return out

    def with_keys(self, ids: np.ndarray, t: int, at: np.ndarray) -> np.ndarray:
        """Which places of a notice have all its key phrases inside, give or take NEAR words."""
        _, notice, keys = self.notices[t]
        whole = np.ones(len(at), bool)
        for k in keys:
            starts = self.places(ids, k)
            last = np.maximum(at + len(notice) + NEAR - len(k), at - NEAR)
            whole &= np.searchsorted(starts, at - NEAR) < np.searchsorted(starts, last, "right")
        return whole

    def scan(self, raw: bytes) -> tuple[int, list[int], list[str], list[str], float]:
        ids = self.numbers(words(raw))
        hits, base = [], []
        for label, phrase in self.base:
            at = self.places(ids, phrase)
            if len(at):
                hits.extend(at.tolist())
                base.append(label)
        held, lacking = {}, 0.0
        for t, (at, shares) in self.matches(ids).items():
            whole = self.with_keys(ids, t, at)
            if whole.any():
                held[t] = at[whole], shares[whole]
            else:
                lacking = max(lacking, float(shares.max()))
        labels, score = set(base), 1.0 if base else lacking / 2
        for t, (at, shares) in held.items():
            n, loud = len(self.notices[t][1]), np.ones(len(at), bool)
            for u, (other, _) in held.items():
                m = len(self.notices[u][1])
                if m > n:  # silent: a place of the longer notice begins in [at + n - m, at]
                    loud &= np.searchsorted(other, at + n - m) == np.searchsorted(other, at, "right")
            if loud.any():
                labels.add(self.notices[t][0])
                score = max(score, float(shares[loud].max()))
        return len(ids), sorted(hits), sorted(set(base)), sorted(labels), score


def word_frequencies(docs: DataFrame, index: Index, text: str) -> tuple[dict[int, int], int]:
    """Documents that hold each licence word, and their number; counted over all documents."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, index)

    def run(batches):
        import pyarrow as pa

        mine = sent()
        counts = np.zeros(len(mine.vocab) + 1, np.int64)
        for batch in batches:
            for raw in raw_texts(batch, text):
                counts[np.unique(mine.numbers(words(raw)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["word", "n"])

    rows = docs.select(text).mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").collect()
    return {r.word: r.n for r in rows if r.word}, docs.count()


def scan_licenses(docs: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """docs with n_words, places (starts of base phrases), base_labels, labels and score."""
    index = index or Index()
    index.weigh(*word_frequencies(docs, index, text))
    sent = send(docs.sparkSession, index)

    def start():
        mine = sent()
        return lambda raws: zip(*map(mine.scan, raws), strict=True) if raws else [[]] * 5

    return add_columns(docs, text, "n_words long, places array<long>, base_labels array<string>, labels array<string>, score double", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), joined("base_labels"), joined("labels"), "score")
