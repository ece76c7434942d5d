"""The license scan as DuckDB SQL. Each template's wording is written out here as a regular expression over the
words of a text, a blank before the first and after each, apart from the templates that the operator parses."""

from __future__ import annotations

_ANY = "(?:[^ ]+ )"
_UNDER = "under (?:the terms of )?(?:the )?"
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    f"in no event shall the {_ANY}{{1,30}}be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or "
    "the use or other dealings in the software "
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
    f"all copies the software is provided as is and {_ANY}{{1,20}}disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
    f"{_ANY}{{1,20}}be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
    "other tortious action arising out of or in connection with the use or performance of this software "
)
_BSD_TWO = (
    f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_ANY}?redistributions of source code must retain the "
    f"above copyright notice this list of conditions and the following disclaimer {_ANY}?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_THIRD = (
    f"{_ANY}?neither the name of {_ANY}{{1,20}}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
)
_BSD_END = (
    f"this software is provided by {_ANY}{{1,20}}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    f"disclaimed in no event shall {_ANY}{{1,20}}be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage "
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    f"{_ANY}{{0,12}}unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
    "express or implied see the license for the specific language governing permissions and limitations under the license "
)


def _gnu(version: int) -> str:
    return (
        f"{_ANY}is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version {version} of "
        f"the license (?:or at your option any later version )?{_ANY}{{1,10}}is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details "
    )


#: (label, regular expression)
WORDINGS = [
    ("mit", f"(?:released|licensed|distributed|available) {_UNDER}mit license "),
    ("mit", _MIT),
    ("apache-2.0", f"licensed {_UNDER}apache license (?:version )?2 0 "),
    ("apache-2.0", _APACHE),
    ("gpl-2.0", f"licensed {_UNDER}gnu general public license (?:version )?2 "),
    ("gpl-3.0", f"licensed {_UNDER}gnu general public license (?:version )?3 "),
    ("gpl-2.0", _gnu(2)),
    ("gpl-3.0", _gnu(3)),
    ("cc-by-4.0", f"licensed {_UNDER}(?:creative commons )?(?:cc by|attribution) 4 0 "),
    ("cc-by-nc-4.0", f"licensed {_UNDER}(?:creative commons )?(?:cc by nc|attribution noncommercial) 4 0 "),
    ("cc-by-sa-4.0", f"licensed {_UNDER}(?:creative commons )?(?:cc by sa|attribution sharealike) 4 0 "),
    ("isc", _ISC),
    ("bsd-2-clause", _BSD_TWO + _BSD_END),
    ("bsd-3-clause", _BSD_TWO + _BSD_THIRD + _BSD_END),
]

_ADDED = ", ".join(f"CASE WHEN regexp_matches(line, ' {wording}') THEN '{label}' END" for label, wording in WORDINGS)
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM d),
l AS (
  SELECT doc_id, len(w) AS n_words, mit || apache || gpl AS places,
    list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda z: z IS NOT NULL) AS b,
    list_filter([{_ADDED}], lambda z: z IS NOT NULL) AS t FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(b, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(b || t)), ',') AS labels, CASE WHEN len(t) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l
"""
