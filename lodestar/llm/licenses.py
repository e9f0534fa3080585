"""License scans: canonical digests of entire texts, joined with those of known licences.

A text is normalised as licence-matching guidelines ask for: case, punctuation, white space, copyright
lines and equivalent spellings make no difference. The digest of what remains is looked up among the
digests of known texts. All of it is DataFrame functions; the known table has a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that name holders and years, dropped as a whole, applied to lower-cased text. What follows "copyright" must be a sign,
#: a year, "by" or a blank to fill in, so that a line of a licence's body that happens to begin with the word stays.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(©|&copy;|c\b|[0-9]|by\b|year\b|yyyy\b)|c\)[^\p{L}\p{N}\n]*[0-9]|©|&copy;)[^\n]*$"
RIGHTS_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
#: Equivalent spellings (fixed values): the word and what it is taken for.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("recognised", "recognized"), ("favour", "favor"), ("honour", "honor"),
    ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("centre", "center"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("https", "http"), ("whilst", "while"), ("per cent", "percent"), ("owner", "holder"), ("owners", "holders"),
)

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Known texts (fixed values): licence id and text, several texts for some.
KNOWN = (
    ("MIT", MIT_BODY),
    ("MIT", "MIT License\n" + MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + MIT_BODY),
    ("BSD-2-Clause", BSD_HEAD + BSD_1 + BSD_2 + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_1 + BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_HEAD + BSD_1 + BSD_2 + BSD_3 + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_1 + BSD_2 + BSD_3 + BSD_END),
    ("ISC", ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + ISC_END),
    ("ISC", "ISC License\n" + ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + ISC_END),
    ("0BSD", ISC_BODY + ".\n" + ISC_END),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


#: Digests of the normalised whole texts of long licences (fixed values); a second one is that of the text up to the end of its terms.
DIGESTS = (
    ("Apache-2.0", "6eaa4793f5a8b0d5faa66c3153fcb1360cb1765d0255accfc085e7c42b80e401"),
    ("Apache-2.0", "b9540988b232006f6e7c5d475e7f290098f8f4bbd8250f4a3e72777f7870d20d"),
    ("Artistic-1.0-Perl", "2d660626e0c71ec2936f0c39b004baf073f7a8d645b56b6191daca4bb56a0e3a"),
    ("CC0-1.0", "0a3627ac5ac95ccdfdaf724b274730f6f2ec1260d6dda5192bc11ce047540184"),
    ("GFDL-1.2", "763fd67087ee54c1928a00c7e66bd59138dfa48fb7cf636fe42a828b1c489bcd"),
    ("GFDL-1.3", "d76fb8c45f11b761aa1870334672b79fa828bbbd142bbd27f820e7f118b97ad6"),
    ("GPL-1.0", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-1.0", "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5"),
    ("GPL-2.0", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-2.0", "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f"),
    ("GPL-3.0", "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63"),
    ("GPL-3.0", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),
    ("LGPL-2.0", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),
    ("LGPL-2.1", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "37c464d014e7991cce21efad605e9a1549cdb4a1f6536357a7290d78a40ee996"),
    ("MPL-2.0", "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791"),
)


def canonical(text: Column) -> Column:
    """The normalised text: words of letters and digits, one space between them and around."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    x = F.regexp_replace(x, RIGHTS_LINE, " ")
    # Two spaces between words, so that each word has its own on both sides when spellings are replaced.
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for word, other in SPELLINGS:
        x = F.replace(x, F.lit(wrapped(word)), F.lit(wrapped(other)))
    return F.regexp_replace(x, " +", " ")


def wrapped(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    """The SHA-256 of the normalised text; null where nothing remains."""
    x = canonical(text)
    return F.when(F.trim(x) != "", F.sha2(x, 256))


def license_digests(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, license), one for each input row; ``license`` is null for other texts.

    Null texts and texts without letters and digits (copyright lines aside) have a null digest and licence.
    Null ids stay null, repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known), "license string, known string").select(digest(F.col("known")).alias("digest"), "license")
    table = table.union(spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license"))
    table = table.groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col).cast("string")).alias("digest"))
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license")


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def sql(x: str) -> str:
        # RE2: \\b is ASCII there as in Java, and (?m) is given as an option.
        out = f"lower({x})"
        for p in (COPYRIGHT_LINE, RIGHTS_LINE):
            out = f"regexp_replace({out}, {quoted(p)}, ' ', 'g')"
        out = f"concat(' ', regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ')"
        for word, other in SPELLINGS:
            out = f"replace({out}, '{wrapped(word)}', '{wrapped(other)}')"
        return f"regexp_replace({out}, ' +', ' ', 'g')"

    digests = ", ".join(f"({quoted(n)}, {quoted(d)})" for n, d in DIGESTS)
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    return f"""WITH known AS (SELECT sha256(c) AS digest, min(license) AS license FROM (SELECT license, {sql('known')} AS c FROM (VALUES {values}) AS k(license, known)) GROUP BY 1 UNION SELECT digest, license FROM (VALUES {digests}) AS d(license, digest)),
rows AS (SELECT doc_id, CASE WHEN text IS NOT NULL AND trim(c) <> '' THEN sha256(c) END AS digest FROM (SELECT doc_id, text, {sql('text')} AS c FROM {table}))
SELECT doc_id, rows.digest, license FROM rows LEFT JOIN known ON rows.digest = known.digest"""
