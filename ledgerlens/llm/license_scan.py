"""Licence scan by canonical digest.

A text is put in canonical form (case, copyright lines, title, line breaks, punctuation, equivalent spellings) and the digest
of the entire canonical text is joined to the digests of known licence texts and notices. Lines are looked up the same way,
so that a notice that stands as a line of its own in a longer document is found too.

The catalogue has the short licences and notices as texts, longer licences by their digests, and what the caller adds as a
table of texts. It has CATALOGUE_ROWS rows at most, so its broadcast is bounded; documents are not shuffled.

A copyright line is one that begins with a copyright sign, with "all rights reserved", or with "copyright" and has a sign or a
year; other lines that begin with the word are text that was wrapped there. A title is a first line that ends in "license".

Edge cases: null text has no digest and no licence; a text that is empty after normalising has the digest of the empty
string and no licence; repeated rows and repeated or null ids give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The public texts of short licences and the usual one-line notices.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
}

# Fixed values: (pattern, replacement with \1) in the order in which they apply; understood alike by Java and RE2.
STEPS = [
    (r"(^|\n)[^a-z0-9©(\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4}|year|yyyy)|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"^\s*[^\n]{0,60}licen[cs]e[ \t]*(\([^)\n]{0,40}\))?[ \t:.]*\n", "\n"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
    (r"([a-z]{3})is(e|ed|er|es|ing|ation|ations)( |$)", r"\1iz\2\3"),
]
# Equivalent spellings, by plain replacement.
EQUIVALENT = [("licence", "license"), ("https", "http"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("centre", "center"), ("favour", "favor"), ("labour", "labor"), ("honour", "honor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment")]


#: Digests of a catalogue at most, and the digest of an empty text, which is no licence's.
CATALOGUE_ROWS, EMPTY = 5000, "d41d8cd98f00b204e9800998ecf8427e"

# Digests of the canonical forms of longer licences as they are published.
LONG_LICENSES = {
    "Apache-2.0": "0ae0c834c28a339f559006a8285f2829",
    "Artistic-1.0-Perl": "f8a4230cb25525c0b4623452e82011a9",
    "BSD-3-Clause-UC": "5226ce4da41af40d26e607d2e52028ce",
    "CC0-1.0": "d0b92f15fc0517d2bfe579ee3d2090a4",
    "GFDL-1.2-only": "9048a906a1560ac16c961615dfdaebff",
    "GFDL-1.3-only": "c34cfb62a88465229ed5afda9888427f",
    "GPL-1.0-only": "b0f4b5a0d368109e9ae68bbb10776916",
    "GPL-2.0-only": "6e8128977833fdf8adb91e1abe877459",
    "GPL-3.0-only": "ea4317607afdd7d4a28711c582c002ee",
    "LGPL-2.0-only": "de5be4c4ea2d6bd0485a5cacde0942da",
    "LGPL-2.1-only": "f0f09bb2d33266e881007d5169169e59",
    "LGPL-3.0-only": "c66601bd909347a3138001ffe5ff1882",
    "MPL-1.1": "cf84e979817f7917811448de162faf44",
    "MPL-2.0": "44d564e1e8d50f7adb97a711954b7020",
}


def canonical(text: Column) -> Column:
    """Canonical form of a text; null stays null."""
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    return [(text, name) for name, text in LICENSES.items()] + [(text, name) for name, texts in NOTICES.items() for text in texts]


def catalogue(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license), one row per digest: the known texts, the longer licences, and texts (text, license) of the caller's.

    A digest of several licences is the first one's by name.
    """
    own = spark.createDataFrame(known_texts(), "text string, license string")
    own = own if texts is None else own.unionByName(texts.select(F.col("text").cast("string"), F.col("license").cast("string")).where("text is not null and license is not null"))
    found = own.select(F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), "license").unionByName(spark.createDataFrame([(d, n) for n, d in LONG_LICENSES.items()], "digest string, license string"))
    return found.where(F.col("digest") != EMPTY).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(documents: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (of the canonical text), license (of the entire text, or null), notices (licences of single lines, sorted, comma-separated, or null).

    texts (text, license) are added to the catalogue.
    """
    spark = documents.sparkSession
    rows = catalogue(spark, texts).limit(CATALOGUE_ROWS + 1).collect()
    if len(rows) > CATALOGUE_ROWS:
        raise ValueError(f"a catalogue has {CATALOGUE_ROWS} digests at most")
    known = spark.createDataFrame(sorted(map(tuple, rows)), "digest string, license string")
    # The digests of all lines meet the catalogue's as sets; only those found are looked up.
    lookup = F.create_map(*[F.lit(x) for row in sorted(map(tuple, rows)) for x in row])
    lines = F.transform(F.array_distinct(F.split(F.col("text"), "\n")), lambda x: F.md5(canonical(x).cast("binary")))
    hits = F.array_intersect(lines, F.array(*[F.lit(digest) for digest, _ in sorted(map(tuple, rows))]))
    found = F.array_sort(F.array_distinct(F.transform(hits, lambda d: F.element_at(lookup, d))))
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = source.select("id", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), F.array_join(found, ",").alias("notices"))
    digests = digests.withColumn("notices", F.when(F.col("notices") != "", F.col("notices")))
    return digests.join(F.broadcast(known), "digest", "left").select(F.col("id").alias(id_col), "digest", "license", "notices")
