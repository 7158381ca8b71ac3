"""License scan: ordered signature rules behind a keyword prefilter, with overlapping detections resolved.

Each license gives up to four rules: its SPDX tag, its page, a grant ("licensed under ..."), its plain name.  A rule
runs only on texts that hold a gate word and one of the rule's keywords, which are worked out from its pattern so that
every match holds one.  Of the detections in a text, one that lies
within another of the same or higher priority is suppressed.  Everything is array functions within a text's own row.
"""

from __future__ import annotations

from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import let

# Label, keyword that any of its texts holds, pattern of its SPDX identifier, pattern of its name,
# pattern of its page ("" if none).  Patterns are for lower-cased text.
LICENSES = [
    ("0bsd", "bsd", r"0bsd", r"(zero[- ]clause bsd|0bsd|bsd zero[- ]clause) licen[cs]e", r"opensource\.org/licenses?/0bsd"),
    ("afl-3.0", "academic free", r"afl-3\.0", r"academic free licen[cs]e,?( version| v\.?)? ?3(\.0)?", r"opensource\.org/licenses?/afl-3\.0"),
    ("agpl-3.0", "affero", r"agpl-3\.0(-only|-or-later|\+)?", r"(gnu )?affero general public licen[cs]e,?( version| v\.?)? ?3(\.0)?", r"gnu\.org/licenses/agpl(-3\.0)?"),
    ("agpl", "affero", r"agpl(-1\.0)?", r"(gnu )?affero general public licen[cs]e", ""),
    ("apache-1.1", "apache", r"apache-1\.1", r"apache( software)? licen[cs]e,?( version| v\.?)? ?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache-2\.0", r"apache( software)? licen[cs]e,?( version| v\.?)? ?2(\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache", "apache", r"apache(-1\.0)?", r"apache( software)? licen[cs]e", r"apache\.org/licenses"),
    ("apsl-2.0", "apple", r"apsl-2\.0", r"apple public source licen[cs]e", r"opensource\.apple\.com/apsl"),
    ("artistic-1.0", "artistic", r"artistic-1\.0(-perl)?", r"(perl )?artistic licen[cs]e,?( version| v\.?)? ?1(\.0)?", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2.0", "artistic", r"artistic-2\.0", r"artistic licen[cs]e,?( version| v\.?)? ?2(\.0)?", r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic", "artistic", r"artistic", r"artistic licen[cs]e", ""),
    ("beerware", "beer", r"beerware", r"beer-?ware licen[cs]e", ""),
    ("blueoak-1.0.0", "blue oak", r"blueoak-1\.0\.0", r"blue oak model licen[cs]e", r"blueoakcouncil\.org/license/1\.0\.0"),
    ("bsd-1-clause", "bsd", r"bsd-1-clause", r"(1|one)[- ]clause bsd licen[cs]e", ""),
    ("bsd-2-clause", "bsd", r"bsd-2-clause", r"((2|two)[- ]clause bsd|simplified bsd|freebsd|bsd (2|two)[- ]clause) licen[cs]e", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"bsd-3-clause(-clear)?", r"((3|three)[- ]clause bsd|(new|revised|modified) bsd|bsd (3|three)[- ]clause) licen[cs]e", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"bsd-4-clause", r"((4|four)[- ]clause bsd|original bsd|bsd (4|four)[- ]clause) licen[cs]e", ""),
    ("bsd", "bsd", r"bsd", r"bsd( style|-style)? licen[cs]e", r"opensource\.org/licenses?/bsd-license"),
    ("bsl-1.0", "boost", r"bsl-1\.0", r"boost software licen[cs]e,?( version| v\.?)?( 1(\.0)?)?", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source", r"busl-1\.1", r"business source licen[cs]e,?( version| v\.?)?( 1(\.1)?)?", r"mariadb\.com/bsl11"),
    ("cc-by-1.0", "cc", r"cc-by-1\.0", r"(cc[- ]by|creative commons attribution),?( version| v\.?)? ?1\.0", r"creativecommons\.org/licenses/by/1\.0"),
    ("cc-by-2.0", "c", r"cc-by-2\.[05]", r"(cc[- ]by|creative commons attribution),?( version| v\.?)? ?2\.[05]", r"creativecommons\.org/licenses/by/2\.[05]"),
    ("cc-by-3.0", "c", r"cc-by-3\.0", r"(cc[- ]by|creative commons attribution),?( version| v\.?)? ?3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", "c", r"cc-by-4\.0", r"(cc[- ]by|creative commons attribution( international)?),?( version| v\.?)? ?4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-nc-3.0", "n", r"cc-by-nc-3\.0", r"(cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial),?( version| v\.?)? ?3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nc-4.0", "n", r"cc-by-nc-4\.0", r"(cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial),?( version| v\.?)? ?4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc", "n", r"cc-by-nc-[12]\.[05]", r"(cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial)", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-nd-4.0", "nd", r"cc-by-nc-nd-4\.0", r"cc[- ]by[- ]nc[- ]nd,?( version| v\.?)? ?4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc-by-nc-nd", "nd", r"cc-by-nc-nd-[123]\.[05]", r"(cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no-?deriv(ative)?s)", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("cc-by-nc-sa-4.0", "sa", r"cc-by-nc-sa-4\.0", r"cc[- ]by[- ]nc[- ]sa,?( version| v\.?)? ?4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-sa", "s", r"cc-by-nc-sa-[123]\.[05]", r"(cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share-?alike)", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nd", "nd", r"cc-by-nd-[1234]\.[05]", r"(cc[- ]by[- ]nd|creative commons attribution[- ]no-?deriv(ative)?s)", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-sa-3.0", "s", r"cc-by-sa-3\.0", r"(cc[- ]by[- ]sa|creative commons attribution[- ]share-?alike),?( version| v\.?)? ?3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-4.0", "s", r"cc-by-sa-4\.0", r"(cc[- ]by[- ]sa|creative commons attribution[- ]share-?alike),?( version| v\.?)? ?4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa", "s", r"cc-by-sa-[12]\.[05]", r"(cc[- ]by[- ]sa|creative commons attribution[- ]share-?alike)", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by", "c", r"cc-by", r"(cc[- ]by|creative commons attribution)( licen[cs]e)?", r"creativecommons\.org/licenses/by/"),
    ("cc0-1.0", "cc0", r"cc0-1\.0", r"cc0( 1\.0)?( universal)?( licen[cs]e| public domain dedication)?", r"creativecommons\.org/publicdomain/zero"),
    ("cddl-1.0", "common development", r"cddl-1\.[01]", r"common development and distribution licen[cs]e", r"opensource\.org/licenses?/cddl"),
    ("cecill-2.1", "cecill", r"cecill-2\.[01]", r"cecill( free software)? licen[cs]e( agreement)?", r"cecill\.info/licences"),
    ("cpl-1.0", "common public", r"cpl-1\.0", r"common public licen[cs]e,?( version| v\.?)?( 1(\.0)?)?", ""),
    ("ecl-2.0", "educational community", r"ecl-2\.0", r"educational community licen[cs]e", r"opensource\.org/licenses?/ecl-2\.0"),
    ("efl-2.0", "eiffel", r"efl-2\.0", r"eiffel forum licen[cs]e", ""),
    ("elastic-2.0", "elastic", r"elastic-2\.0", r"elastic licen[cs]e,?( version| v\.?)?( 2(\.0)?)?", r"elastic\.co/licensing/elastic-license"),
    ("epl-1.0", "eclipse", r"epl-1\.0", r"eclipse public licen[cs]e,?( -)?( version| v\.?)? ?1(\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"epl-2\.0", r"eclipse public licen[cs]e,?( -)?( version| v\.?)? ?2(\.0)?", r"eclipse\.org/legal/epl-(v20|2\.0)"),
    ("epl", "eclipse", r"epl", r"eclipse public licen[cs]e", ""),
    ("eupl-1.2", "european union", r"eupl-1\.[012]", r"european union public licen[cs]e", r"joinup\.ec\.europa\.eu/.{0,60}eupl"),
    ("gfdl-1.3", "free documentation", r"gfdl-1\.[123](-only|-or-later)?", r"(gnu )?free documentation licen[cs]e", r"gnu\.org/licenses/fdl"),
    ("gpl-1.0", "general public", r"gpl-1\.0(-only|-or-later|\+)?", r"(gnu )?general public licen[cs]e,?( version| v\.?)? ?1(\.0)?", ""),
    ("gpl-2.0", "gpl", r"gpl-2\.0(-only|-or-later|\+)?", r"gnu gpl,?( version| v\.?)? ?2(\.0)?", r"gnu\.org/licenses/(old-licenses/)?gpl-2\.0"),
    ("gpl-2.0", "general public", r"gpl-?2(\.0)?", r"(gnu )?general public licen[cs]e,?( version| v\.?)? ?2(\.0)?", r"opensource\.org/licenses?/gpl-2\.0"),
    ("gpl-3.0", "gpl", r"gpl-3\.0(-only|-or-later|\+)?", r"gnu gpl,?( version| v\.?)? ?3(\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-3.0", "general public", r"gpl-?3(\.0)?", r"(gnu )?general public licen[cs]e,?( version| v\.?)? ?3(\.0)?", r"opensource\.org/licenses?/gpl-3\.0"),
    ("gpl", "general public", r"gpl", r"(gnu )?general public licen[cs]e", r"gnu\.org/(licenses|copyleft)/gpl"),
    ("hpnd", "historical permission", r"hpnd", r"historical permission notice and disclaimer licen[cs]e", ""),
    ("ijg", "independent jpeg", r"ijg", r"independent jpeg group licen[cs]e", ""),
    ("isc", "isc", r"isc", r"\bisc licen[cs]e", r"opensource\.org/licenses?/isc"),
    ("json", "json", r"json", r"\bjson licen[cs]e", r"json\.org/license"),
    ("lgpl-2.0", "general public", r"lgpl-2\.0(-only|-or-later|\+)?", r"(gnu )?library general public licen[cs]e,?( version| v\.?)?( 2(\.0)?)?", r"gnu\.org/licenses/(old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "general public", r"lgpl-2\.1(-only|-or-later|\+)?", r"(gnu )?lesser general public licen[cs]e,?( version| v\.?)? ?2\.1", r"gnu\.org/licenses/(old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "general public", r"lgpl-3\.0(-only|-or-later|\+)?", r"(gnu )?lesser general public licen[cs]e,?( version| v\.?)? ?3(\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "general public", r"lgpl", r"(gnu )?(lesser|library) general public licen[cs]e", r"gnu\.org/licenses/lgpl"),
    ("libpng", "libpng", r"libpng(-2\.0)?", r"libpng licen[cs]e", ""),
    ("lppl-1.3c", "project public", r"lppl-1\.3[ac]?", r"latex project public licen[cs]e", r"latex-project\.org/lppl"),
    ("mit", "mit", r"mit", r"\b(mit|expat|x11) licen[cs]e", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit-0", r"\b(mit no attribution|mit-0) licen[cs]e", ""),
    ("mpl-1.1", "mozilla", r"mpl-1\.[01]", r"mozilla public licen[cs]e,?( version| v\.?)? ?1\.[01]", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mpl-2\.0", r"mozilla public licen[cs]e,?( version| v\.?)? ?2(\.0)?", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "mozilla", r"mpl", r"mozilla public licen[cs]e", r"mozilla\.org/mpl"),
    ("ms-pl", "microsoft", r"ms-pl", r"microsoft public licen[cs]e", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", r"ms-rl", r"microsoft reciprocal licen[cs]e", r"opensource\.org/licenses?/ms-rl"),
    ("mulanpsl-2.0", "mulan", r"mulanpsl-2\.0", r"mulan permissive software licen[cs]e", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("ncsa", "ncsa", r"ncsa", r"(university of illinois/)?ncsa open source licen[cs]e", r"opensource\.org/licenses?/ncsa"),
    ("odbl-1.0", "open d", r"odbl-1\.0", r"open (data commons open )?database licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", r"odc-by-1\.0", r"open data commons attribution licen[cs]e", r"opendatacommons\.org/licenses/by"),
    ("ofl-1.1", "open font", r"ofl-1\.[01]", r"(sil )?open font licen[cs]e,?( version| v\.?)?( 1\.[01])?", r"scripts\.sil\.org/ofl"),
    ("openssl", "openssl", r"openssl", r"openssl licen[cs]e", r"openssl\.org/source/license"),
    ("osl-3.0", "open software", r"osl-3\.0", r"open software licen[cs]e,?( version| v\.?)?( 3(\.0)?)?", r"opensource\.org/licenses?/osl-3\.0"),
    ("pddl-1.0", "public domain dedication", r"pddl-1\.0", r"public domain dedication and licen[cs]e", r"opendatacommons\.org/licenses/pddl"),
    ("php-3.0", "php", r"php-3\.0[1]?", r"php licen[cs]e,?( version| v\.?)?( 3\.01?)?", r"php\.net/license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql licen[cs]e", r"postgresql\.org/about/licence"),
    ("public-domain", "public domain", r"public-domain", r"(placed|released|dedicated) (in|into|to) the public domain", ""),
    ("psf-2.0", "python", r"(psf|python)-2\.0", r"python( software foundation)? licen[cs]e,?( version| v\.?)?( 2)?", r"python\.org/psf/license"),
    ("qpl-1.0", "public licen", r"qpl-1\.0", r"\bq public licen[cs]e", ""),
    ("rpl-1.5", "reciprocal public", r"rpl-1\.[15]", r"reciprocal public licen[cs]e", ""),
    ("ruby", "ruby", r"ruby", r"ruby licen[cs]e", r"ruby-lang\.org/en/about/license"),
    ("sleepycat", "sleepycat", r"sleepycat", r"sleepycat licen[cs]e", ""),
    ("sspl-1.0", "server side", r"sspl-1\.0", r"server side public licen[cs]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("tcl", "tcl", r"tcl", r"\btcl(/tk)? licen[cs]e", r"tcl\.tk/software/tcltk/license"),
    ("unicode-dfs-2016", "unicode", r"unicode-(dfs-201[56]|3\.0)", r"unicode licen[cs]e( agreement)?", r"unicode\.org/(license|copyright)"),
    ("unlicense", "unlicense", r"unlicense", r"\bunlicense\b", r"unlicense\.org"),
    ("upl-1.0", "universal permissive", r"upl-1\.0", r"universal permissive licen[cs]e", r"opensource\.org/licenses?/upl"),
    ("vim", "vim", r"vim", r"\bvim licen[cs]e", ""),
    ("w3c", "w3c", r"w3c(-20150513)?", r"w3c software( notice)?( and)? licen[cs]e", r"w3\.org/consortium/legal"),
    ("watcom-1.0", "watcom", r"watcom-1\.0", r"sybase open watcom public licen[cs]e", ""),
    ("wtfpl", "wtfpl", r"wtfpl", r"\bwtfpl( licen[cs]e)?", r"wtfpl\.net"),
    ("zlib", "zlib", r"zlib(-acknowledgement)?", r"\bzlib(/libpng)? licen[cs]e", r"opensource\.org/licenses?/zlib"),
    ("zpl-2.1", "zope", r"zpl-(1\.1|2\.[01])", r"zope public licen[cs]e,?( version| v\.?)?( 2\.[01])?", r"opensource\.org/licenses?/zpl-2\.0"),
]
GATES = ["licen", "spdx", "public domain", "cc by", "cc-by", "cc0", "creative", "gpl", "wtfpl", "opensource.org", "www.apache.org", "gnu.org"]
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
# End of fixed values.

GRANT = r"\b(licen[cs]ed|released|distributed|available|published|provided|offered)( to you)? under (the )?(terms of )?(the )?"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = 3
BASE_SCORE = 0.8


def keywords(pattern: str) -> list[str]:
    """Strings of which every match of ``pattern`` holds one, as long as possible; a grant's come from the license's name."""
    return sorted(_needed(sre.parse(pattern.removeprefix(GRANT))) or {""})


def _needed(parts) -> set[str] | None:
    """Strings of which every match of a parsed sequence holds one; None if it needs none."""
    found, run = [], {""}
    for op, value in parts:
        one = None
        if op is sre.LITERAL:
            one = {chr(value)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) * len(run) <= 4:
            one = {chr(v) for _, v in value}
        if one is not None:
            run = {r + c for r in run for c in one}
            continue
        found.append(run)
        run = {""}
        if op is sre.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(value[2]))
        elif op is sre.BRANCH:
            ways = [_needed(way) for way in value[1]]
            found.append(None if None in ways else set().union(*ways))
    found = [f for f in [*found, run] if f and "" not in f]
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def gates() -> list[str]:
    """GATES, and every rule's keywords that hold none of them: a text without any of these matches no rule."""
    every = {k for r in rules() for k in keywords(r[2])}
    return [*GATES, *sorted(k for k in every if not any(g in k for g in {*GATES, *every} - {k}))]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, pattern, label, score) of every rule, those of higher priority first, in fixed order.

    keyword: the string that every match holds; empty where ``keywords`` gives more than one.
    """
    out = []
    for label, _, tag, name, page in LICENSES:
        out.append((3, rf"spdx-license-identifier:\s{{0,8}}{tag}(?![a-z0-9.+-])", label, 1.0))
        if page:
            out.append((3, rf"https?://(www\.)?{page}", label, 0.95))
        out.append((2, rf"{GRANT}{name}(?![a-z0-9])", label, 0.9))
        out.append((1, rf"(?<![a-z0-9]){name}(?![a-z0-9])", label, 0.7))
    only = lambda pattern: own[0] if len(own := keywords(pattern)) == 1 else ""
    return [(p, only(x), x, m, s) for p, x, m, s in sorted(out, key=lambda r: -r[0])]


def _literal_rules() -> Column:
    return F.array(
        *[
            F.struct(F.lit(p).alias("priority"), F.array(*map(F.lit, keywords(x))).alias("keywords"), F.lit(x).alias("pattern"), F.lit(m).alias("label"), F.lit(s).alias("score"), F.lit(i).alias("rule"))
            for i, (p, _, x, m, s) in enumerate(rules())
        ]
    )


def _detections(text: Column, rule: Column) -> Column:
    """Intervals of the rule's matches: what lies between matches tells where each begins."""

    def place(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        walked = F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1),
            start,
            lambda s, i: F.struct(
                (s["at"] + F.length(F.get(between, i)) + F.length(F.get(found, i))).alias("at"),
                F.array_append(s["starts"], s["at"] + F.length(F.get(between, i))).alias("starts"),
            ),
        )["starts"]
        return F.transform(
            walked,
            lambda at, i: F.struct(at.alias("start"), (-at - F.length(F.get(found, i))).alias("minus_end"), (-rule["priority"]).alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score")),
        )

    none = F.array().cast("array<struct<start:int,minus_end:int,level:int,rule:int,label:string,score:double>>")
    return let(
        F.regexp_extract_all(text, rule["pattern"], F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, rule["pattern"], -1), lambda between: place(found, between))),
    )


def _surviving(hits: Column) -> Column:
    """struct(labels, score) of the detections within no other of the same or higher priority.

    Sorted by start, then the longer, the higher priority and the earlier rule first, whatever contains a
    detection stands before it; the farthest end so far at each priority then tells.
    """
    begin = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(s: Column, h: Column) -> Column:
        hidden = F.exists(F.transform(s["ends"], lambda e, i: (i + 1 >= -h["level"]) & (e >= -h["minus_end"])), lambda x: x)
        ends = F.transform(s["ends"], lambda e, i: F.when(i + 1 == -h["level"], F.greatest(e, -h["minus_end"])).otherwise(e))
        return F.struct(
            ends.alias("ends"),
            F.when(hidden, s["labels"]).otherwise(F.array_union(s["labels"], F.array(h["label"]))).alias("labels"),
            F.when(hidden, s["score"]).otherwise(F.greatest(s["score"], h["score"])).alias("score"),
        )

    return F.aggregate(F.sort_array(hits), begin, step, lambda s: F.struct(s["labels"].alias("labels"), s["score"].alias("score")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score; such columns are replaced, all others stay.

    A null text counts as empty: no words, no labels (empty strings), null places, score 0.  score is the largest
    of the surviving detections', and BASE_SCORE for a base phrase.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every = sorted({k for r in rules() for k in keywords(r[2])})
    # Each step apart, so that the text is lower-cased and cut into words once for each row.
    lower = docs.withColumn("__license_low", low)
    gated = lower.withColumns(
        {
            "__license_words": F.regexp_extract_all("__license_low", F.lit(WORD), F.lit(0)),
            "__license_gate": F.greatest(*[F.contains(F.col("__license_low"), F.lit(g)).cast("int") for g in gates()]) == 1,
        }
    )
    stands = lambda i: F.coalesce(
        *[F.when(F.forall(F.array(*[F.coalesce(F.get(F.col("__license_words"), i + j) == w, F.lit(False)) for j, w in enumerate(phrase)]), lambda x: x), F.lit(label)) for phrase, label in BASE]
    )
    places = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("__license_words") - 1), lambda i: F.struct(i.cast("long").alias("at"), stands(i).alias("label"))),
        lambda x: x["label"].isNotNull(),
    )
    here = lambda: F.filter(F.array(*map(F.lit, every)), lambda k: F.contains(F.col("__license_low"), k))
    hits = let(
        here(),
        lambda own: F.flatten(F.transform(F.filter(_literal_rules(), lambda r: F.arrays_overlap(own, r["keywords"])), lambda r: _detections(F.col("__license_low"), r))),
    )
    found = gated.withColumns(
        {
            "n_words": F.size("__license_words").cast("long"),
            "__license_base": F.when(F.col("__license_gate") & (F.size("__license_words") > 0), places).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")),
            "__license_method": F.when(F.col("__license_gate"), _surviving(hits)).otherwise(F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))),
        }
    )
    base = F.sort_array(F.array_distinct(F.transform("__license_base", lambda x: x["label"])))
    return found.withColumns(
        {
            "n_base": F.size("__license_base").cast("long"),
            "first_word": F.array_min(F.transform("__license_base", lambda x: x["at"])),
            "last_word": F.array_max(F.transform("__license_base", lambda x: x["at"])),
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(F.sort_array(F.array_union(base, F.col("__license_method.labels"))), ","),
            "score": F.greatest(F.col("__license_method.score"), F.when(F.size("__license_base") > 0, F.lit(BASE_SCORE)).otherwise(0.0)),
        }
    ).drop("__license_low", "__license_words", "__license_gate", "__license_base", "__license_method")
