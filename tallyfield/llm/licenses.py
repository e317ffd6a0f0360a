"""Licence scan: lines, paragraphs and whole texts compared with licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised the same way: lower case, everything but letters and digits is a blank. The coefficient of two bags of
bigrams is twice their common count over the sum of their sizes. It can reach the threshold t only if the sizes differ by a factor of at most
(2 - t) / t, so a unit of text is compared only with templates within those bounds, and only where it shares a bigram with one.

DataFrame functions only: words are exploded and matched with the template bigrams inside one stage, so only matching bigrams are ever shuffled. The
template list is part of this module, which bounds the broadcast.

Defined results: NULL and empty texts and units of one word match nothing; repeated rows report once; ties go to the first template by name; NULL ids are reported
under NULL; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD_PERCENT = 75
# fixed values: public notices and short texts of licences
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normalised(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bounds(size: Column, percent: int) -> tuple[Column, Column]:
    """Least and largest bag size that can reach the threshold with a bag of this size."""
    return F.ceil(size * percent / (200 - percent)), F.floor(size * (200 - percent) / percent)


def template_bigrams(spark, templates: dict[str, str]) -> DataFrame:
    """(license, t_size, low, high, g, t_count) of the templates."""
    rows = spark.createDataFrame(sorted((k, normalised(v)) for k, v in templates.items()), "license string, text string")
    w = rows.select("license", F.split("text", " ").alias("w")).withColumn("t_size", F.size("w") - 1)
    pairs = w.select("license", "t_size", "w", F.posexplode("w").alias("at", "x")).where("at < t_size")
    return pairs.select("license", "t_size", F.xxhash64(F.get("w", F.col("at")), F.get("w", F.col("at") + 1)).alias("g")).groupBy("license", "t_size", "g").agg(F.count(F.lit(1)).alias("t_count"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, unit, unit_no, license, dice): the best template of each line, paragraph of several lines, and text of several paragraphs that reaches the threshold."""
    spark = docs.sparkSession
    sizes = [len(normalised(v).split(" ")) - 1 for v in templates.values()]
    least, most = -(-min(sizes) * percent // (200 - percent)), max(sizes) * (200 - percent) // percent
    text = F.col("text").cast("string")
    blank = r"\n[\x20\x09\x0B-\x0D]*(?:\n[\x20\x09\x0B-\x0D]*)+"

    def units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), x.alias("part")))
    lines = units("line", F.split(text, "\n"))
    paragraphs = units("paragraph", F.split(text, blank))
    whole = units("text", F.array(text))
    none = F.array().cast(lines_type := "array<struct<unit:string,unit_no:bigint,part:string>>")
    every = F.concat(lines, F.when(F.contains(text, F.lit("\n")), F.filter(paragraphs, lambda u: F.contains(u["part"], F.lit("\n")))).otherwise(none),
                     F.when(text.rlike(blank), whole).otherwise(none)).cast(lines_type)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.explode(every).alias("u")).select("doc_id", "rid", "u.unit", "u.unit_no", "u.part")
    # a normalised unit of b bigrams has at least 2b + 1 characters' worth of words; longer ones are cut by their exact size below
    rows = rows.withColumn("words", F.split(_plain(F.col("part")), " ")).withColumn("size", (F.size("words") - 1).cast("long"))
    rows = rows.where((F.col("size") >= max(1, least)) & (F.col("size") <= most))
    pairs = rows.select("doc_id", "rid", "unit", "unit_no", "size", "words", F.posexplode("words").alias("at", "x")).where("at < size")
    pairs = pairs.select("doc_id", "rid", "unit", "unit_no", "size", F.xxhash64(F.get("words", F.col("at")), F.get("words", F.col("at") + 1)).alias("g"))
    low, high = _bounds(F.col("t_size"), percent)
    grams = template_bigrams(spark, templates).withColumns({"low": low, "high": high})
    hits = pairs.join(F.broadcast(grams), "g").where("size between low and high")
    counted = hits.groupBy("doc_id", "rid", "unit", "unit_no", "size", "license", "t_size", "g", "t_count").agg(F.count(F.lit(1)).alias("c"))
    common = counted.groupBy("doc_id", "rid", "unit", "unit_no", "size", "license", "t_size").agg(F.sum(F.least("c", "t_count")).alias("common"))
    found = common.where(F.col("common") * 200 >= (F.col("size") + F.col("t_size")) * percent)
    dice = F.col("common") * 2 / (F.col("size") + F.col("t_size"))
    best = found.groupBy("doc_id", "rid", "unit", "unit_no").agg(F.min(F.struct((-dice).alias("low"), "license")).alias("b"))
    return best.select("doc_id", "unit", "unit_no", "b.license", (-F.col("b.low")).alias("dice")).distinct()
