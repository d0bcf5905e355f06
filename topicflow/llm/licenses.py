"""Licence recognition by sentences and rules, on the JVM only.

A text is cut into sentences, which are normalised (ASCII lower case, letters and digits separated by one
blank). What is no known line by itself is read on over single line ends, with comment marks, until the sentence
or paragraph ends; a sentence may begin and end at any line of it. Known sentences are mapped to identifiers, a version being part of it (``GPLGrant:3``). Ordered rules
then look for sequences of identifiers: where one matches, its licence is noted and its identifiers are used
up, so that later, weaker rules don't see them. Identifiers that no rule used are reported too.

Everything is one narrow projection: no shuffle, no Python. Texts without any word that licence sentences
have are not cut at all.

Defined results: null, empty and licence-free texts give empty strings; repeated rows are each
recognised; other columns are kept, those with the name of a result column replaced. Very long texts are cut as a whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"\n|[.!?;]+([ \t\n\r\f]+|\z)"
LINE, END, KNOWN = "\x01", "\x02", "\x03"
OTHER = "[^a-z0-9]+"
EMPTY_LINE = r"\n[^a-z0-9\n]*(?=\n)"
# a semicolon inside the notices of the GPL
INNER = rf";(?=[^a-z0-9\x02]+(?:you{OTHER}can{OTHER}redistribute|either{OTHER}version))"
SENTENCE_END = r"[.!?;]+([ \t\n\r\f\x01\x02]+|\z)"
HINT = "licen[sc]e|(?:released|distributed) under|provided by|permission|redistribut|warrant|liable|public domain|spdx|neither the name"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VERSION = r"(?:v|version)? ?(\d+(?: \d+)*)"
# identifier, pattern of the whole normalised sentence; a group is the version or name
SENTENCES = [
    ("ApacheGrant", rf"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?apache license {VERSION}(?: the license)?"),
    ("ApacheLimit", "you may not use this file except in compliance with the license"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("MITGrant", "(?:this \\w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?(?:mit|expat) license"),
    ("MITPermission", "permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies.*"),
    ("MITAsIs", "the software is provided as is without warranty of any kind.*"),
    ("MITLiable", "in no event shall the authors or copyright holders be liable.*"),
    ("ISCPermission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BSDGrant", rf"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?(?:new |simplified |{VERSION} clause )?bsd license"),
    ("BSDUse", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSDSource", "(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", "(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", "(?:3 )?neither the name of .* may be used to endorse or promote products.*"),
    ("BSDAsIs", "this software is provided by the (?:copyright holders|author|regents) .*as is.*"),
    ("AGPLGrant", rf"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu affero general public license {VERSION}"),
    ("LGPLGrant", rf"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu (?:lesser|library) general public license {VERSION}"),
    ("GPLGrant", rf"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu general public license {VERSION}"),
    ("GPLFree", rf"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .*{VERSION} of the license.*"),
    ("GPLWarranty", "this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("MPLForm", rf"this source code form is subject to the terms of the mozilla public license {VERSION}"),
    ("CCGrant", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:a )?(?:cc|creative commons) ((?:by|zero|0)(?: (?:nc|nd|sa))*(?: \d+)*)(?: license)?"),
    ("CC0", "(?:cc0|creative commons zero).*public domain.*"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("SPDX", r"spdx license identifier ([a-z0-9 ]+)"),
]
# licence, identifiers in order; a trailing colon takes the version of that identifier
RULES = [
    ("Apache", ["ApacheGrant:", "ApacheLimit", "ApacheAsIs"]),
    ("MIT", ["MITPermission", "MITNotice", "MITAsIs", "MITLiable"]),
    ("MIT", ["MITPermission", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITPermission", "MITNotice"]),
    ("BSD-3", ["BSDUse", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"]),
    ("BSD-3", ["BSDUse", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2", ["BSDUse", "BSDSource", "BSDBinary", "BSDAsIs"]),
    ("BSD-2", ["BSDUse", "BSDSource", "BSDBinary"]),
    ("GPL", ["GPLFree:", "GPLWarranty"]),
    ("GPL", ["GPLFree:"]),
    ("AGPL", ["AGPLGrant:"]),
    ("LGPL", ["LGPLGrant:"]),
    ("GPL", ["GPLGrant:"]),
    ("Apache", ["ApacheGrant:"]),
    ("MPL", ["MPLForm:"]),
    ("MIT", ["MITGrant"]),
    ("ISC", ["ISCPermission"]),
    ("BSD", ["BSDGrant:"]),
    ("BSD", ["BSDGrant"]),
    ("CC", ["CCGrant:"]),
    ("CC0", ["CC0"]),
    ("Unlicense", ["Unlicense"]),
    ("SPDX", ["SPDX:"]),
]


def _groups(pattern: str) -> bool:
    return "(" in pattern.replace("(?:", "")


def rule_pattern(ids: list[str]) -> str:
    """Identifiers stand in a string as ``<A><B:2>``; the version, if taken, is group 1."""
    return "".join(f"<{i}([^>]*)>" if i.endswith(":") else f"<{i}>" for i in ids)


def wrapped(pattern: str) -> str:
    """The pattern for normalised lines: whole lines of a paragraph, blanks being line ends too (not inside versions)."""
    tail = "" if pattern.endswith(".*") else "$"
    return "(?ms)^" + re.sub(r" (?!\\d)", r"[ \\n]", pattern.removesuffix(".*")) + tail


def identifier(sentence: Column, lines: bool = False) -> Column:
    """``<Id>`` or ``<Id:version>`` of a normalised sentence, null for an unknown one; ``lines``: of several lines."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        if lines and name == "SPDX":  # a tag, it ends with its line
            continue
        whole = wrapped(pattern) if lines else f"^{pattern}$"
        value = F.lit(f"<{name}>")
        if _groups(pattern):
            version = F.regexp_extract(sentence, whole, 1)
            value = F.when(version == "", value).otherwise(F.concat(F.lit(f"<{name}:"), F.translate(version, " \n", ".."), F.lit(">")))
        out = F.when(sentence.rlike(whole), value).otherwise(out)
    return out


def _namer(license_name: str, versioned: bool):
    def name(version: Column) -> Column:
        return F.concat(F.lit(license_name + "-"), version) if versioned else F.lit(license_name)

    return name


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, UPPER.lower()), "[^a-z0-9]+", " "))


def normalised_lines(sentence: Column) -> Column:
    lines = F.regexp_replace(sentence, f"[^a-z0-9{LINE}]+", " ")
    return F.trim(F.regexp_replace(lines, f" ?{LINE} ?", "\n"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``licenses``, ``license_sentences`` and ``unmatched`` (identifiers), as joined strings."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower())
    marked = F.translate(lower, LINE + END + KNOWN, "   ")
    for pattern, mark in ((EMPTY_LINE, END), (INNER, LINE), (SENTENCE_END, END)):
        marked = F.regexp_replace(marked, pattern, mark)
    hint = HINT.replace(" ", OTHER)
    parts = F.when(lower.rlike(hint), F.split(F.translate(marked, "\n", LINE), rf"(?<=[{LINE}{END}])")).otherwise(F.array())
    alone = lambda s: F.when(s.rlike(HINT), F.concat(F.lit(END + KNOWN), identifier(normalised(s)), F.lit(END)))
    rest = F.split(F.array_join(F.transform(parts, lambda s: F.coalesce(alone(s), s)), ""), END)
    some = F.filter(rest, lambda s: s.startswith(KNOWN) | (s.contains(LINE) & s.rlike(hint)))
    known = lambda s: F.when(s.startswith(KNOWN), F.substring(s, 2, 1 << 30)).otherwise(identifier(normalised_lines(s), True))
    ids = F.array_join(F.array_compact(F.transform(some, known)), "")
    out = docs.withColumn("_ids", ids).withColumn("_rest", F.col("_ids")).withColumn("_found", F.array().cast("array<string>"))
    for license_name, sequence in RULES:
        pattern = rule_pattern(sequence)
        versions = F.regexp_extract_all("_rest", F.lit(pattern), F.lit(1 if "(" in pattern else 0))
        name = _namer(license_name, "(" in pattern)
        out = out.withColumn("_found", F.when(F.col("_rest") == "", F.col("_found")).otherwise(F.concat("_found", F.transform(versions, name))))
        out = out.withColumn("_rest", F.when(F.col("_rest") == "", F.lit("")).otherwise(F.regexp_replace("_rest", pattern, "")))
    return (
        out.withColumn("licenses", F.array_join(F.array_sort(F.array_distinct("_found")), ","))
        .withColumn("license_sentences", F.col("_ids"))
        .withColumn("unmatched", F.col("_rest"))
        .drop("_ids", "_rest", "_found")
    )


def license_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The recognition of sentences on one line as one DuckDB statement; it does not read on over line ends."""
    case = []
    for name, pattern in SENTENCES:
        value = f"'<{name}>'"
        if _groups(pattern):
            version = f"regexp_extract(s, '^{pattern}$', 1)"
            value = f"CASE WHEN {version} = '' THEN {value} ELSE '<{name}:' || translate({version}, ' ', '.') || '>' END"
        case.append(f"WHEN regexp_matches(s, '^{pattern}$') THEN {value}")
    steps = [f"r0 AS (SELECT {id_col}, ids, ids AS rest, []::VARCHAR[] AS found FROM joined)"]
    for i, (name, sequence) in enumerate(RULES):
        pattern = rule_pattern(sequence)
        hits = f"regexp_extract_all(rest, '{pattern}', {1 if '(' in pattern else 0})"
        mapped = f"list_transform({hits}, lambda v: '{name}-' || v)" if "(" in pattern else f"list_transform({hits}, lambda v: '{name}')"
        steps.append(
            f"r{i + 1} AS (SELECT {id_col}, ids, regexp_replace(rest, '{pattern}', '', 'g') AS rest, list_concat(found, {mapped}) AS found FROM r{i})"
        )
    lower = f"translate(coalesce({text_col}, ''), '{UPPER}', '{UPPER.lower()}')"
    split = SPLIT.replace("(", "(?:")
    return (
        f"WITH sentences AS (SELECT {id_col}, list_transform(regexp_split_to_array({lower}, '{split}'), "
        f"lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS ss FROM {table}), "
        f"joined AS (SELECT {id_col}, coalesce(array_to_string(list_filter(list_transform(ss, lambda s: CASE {' '.join(case)} END), "
        f"lambda x: x IS NOT NULL), ''), '') AS ids FROM sentences), {', '.join(steps)} "
        f"SELECT {id_col}, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses, "
        f"ids AS license_sentences, rest AS unmatched FROM r{len(RULES)}"
    )
