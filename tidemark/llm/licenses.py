"""License scan by conditional compression.

The whole text is one sequence of words; line breaks, blanks and comment marks between them do not count. Cue words open candidate
blocks: up to the longest template's length before a cue, each word that may be the first of a template to stand opens one, as long
as the longest template and a quarter more. Each block is compressed by zstandard alone and with every template as raw dictionary;
the more a template explains the block, the more bytes it saves. Templates are ranked by the bytes saved (ties by name) and
confirmed in that order by the exact differences in wording, until one holds: at least ``AGREE`` of the template's words must stand
at the start of the block in their order, with few words between; words that tell licenses apart (``TELLING`` and numbers of
versions) must be the same. So a full notice goes before a short one that it begins with, since it saves more. Templates that save
less than ``LEAST_SAVED`` of their own bytes are not confirmed: a notice that agrees saves far more.

Null and empty texts have no blocks. All blocks of a text are looked at, however long it is. Repeated rows are scanned each; extra
columns pass through ``scan``; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table

#: Short notices of common licenses, as their licensors publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-2-or-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
#: A text without any of these has no notice. Every template holds one.
CUES = re.compile("|".join(c.replace(" ", "[^a-z0-9]+") for c in ("licen", "copyright", "rights reserved", "permission", "public domain", "redistribut", "creative commons", "free software", "source code form")))
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
AGREE, SLACK, LEAST_SAVED = 0.95, 1.25, 0.15
#: Words that tell licenses apart; so do numbers after "version" or "v", and "library" in "Library General Public License".
TELLING = re.compile(r"affero|lesser|by(-(nc|nd|sa))*|nc|nd|sa|(attribution-?)?(sharealike|noncommercial|noderivatives|noderivs)(-.*)?|v\d+(\.\d+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(words of the template that are missing, words put between, first matched word of the block)."""
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), 0, 0
    same = sum(m.size for m in runs)
    return len(template) - same, runs[-1].b + runs[-1].size - runs[0].b - same, runs[0].b


def telling(words: list[str]) -> list[str]:
    """The words that tell licenses apart, in order; "by" only where a Creative Commons license is named."""
    pairs = zip(["", *words], words, [*words[1:], ""])
    return [w for before, w, after in pairs if (TELLING.fullmatch(w) and (w != "by" or before == "cc")) or (w[0].isdigit() and before in ("version", "v")) or (w == "library" and after == "general")]


def scanner(least_saved: float = LEAST_SAVED, every_word: bool = False):
    """The function text -> list of (license, line, saved share, missing, added), in order of lines. ``every_word`` opens blocks at all
    words, which finds the same and takes long."""
    import zstandard as zstd

    plain = zstd.ZstdCompressor(level=3)
    shelf, opening = [], set()
    for name, text in sorted(TEMPLATES.items()):
        w = wording(text)
        raw = " ".join(w).encode()
        packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT))
        shelf.append((name, w, int(len(w) * SLACK) + 1, len(raw), packer, telling(w)))
        opening.update(w[: int((1 - AGREE) * len(w) + 1e-9) + 1])  # no more words are missing, so one of these stands
    longest = max(size for _, _, size, _, _, _ in shelf)

    def winner(words: list[str], start: int):
        """(template's length, license, saved share, missing, added) of the first ranked template that holds at ``start``."""
        block = " ".join(words[start : start + longest]).encode()
        alone = len(plain.compress(block))
        ranked = [(alone - len(packer.compress(block)), name, w, size, raw, tells) for name, w, size, raw, packer, tells in shelf]
        for saved, name, w, size, raw, tells in sorted(ranked, key=lambda r: (-r[0], r[1])):
            if saved < least_saved * raw:
                continue
            own = words[start : start + size]
            missing, added, first = differences(w, own)
            if first == 0 and max(missing, added) <= (1 - AGREE) * len(w) and telling(own[: len(w) - missing + added]) == tells:
                return len(w), name, saved / alone, missing, added
        return None

    def scan_text(text: str) -> list[tuple]:
        low = text.lower()
        cues = [m.start() for m in CUES.finditer(low)]
        if not cues:
            return []
        words, at = [], []
        for m in _WORD.finditer(low):
            words.append(m.group())
            at.append(m.start())
        out, start, line, seen = [], 0, 0, 0  # words before ``start`` are done with; ``line`` counts the breaks before ``seen``
        for cue in cues:
            c = bisect_right(at, cue) - 1
            start = max(start, c - longest)
            while start <= c:
                best = winner(words, start) if every_word or words[start] in opening else None
                if best is None:
                    start += 1
                    continue
                n, name, saved, missing, added = best
                line, seen = line + low.count("\n", seen, at[start]), at[start]
                out.append((name, line, float(saved), missing, added))
                start += n - missing + added
        return out

    return scan_text


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``notices_``: what was found in each text. Map-only."""
    at = docs.columns.index(text_col)
    notice = T.StructType([T.StructField("license", T.StringType()), T.StructField("line", T.LongType()), T.StructField("saved", T.DoubleType()), T.StructField("missing", T.LongType()), T.StructField("added", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("notices_", T.ArrayType(notice))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("saved", pa.float64()), ("missing", pa.int64()), ("added", pa.int64())]))

    def add(batches):
        scan_text = scanner()
        for batch in batches:
            found = [[dict(zip(("license", "line", "saved", "missing", "added"), x)) for x in scan_text(t.as_py() or "")] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "notices_"])

    return docs.mapInArrow(add, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Per document: the licenses it names, how many notices, and how exact the wording is."""
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col("notices_")
    return d.select("doc_id", F.array_sort(F.array_distinct(n["license"])).alias("licenses"), F.size(n).cast("long").alias("n_notices"), F.array_max(n["saved"]).alias("best_saved"),
                    F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x["missing"] + x["added"]).alias("changed_words"))
