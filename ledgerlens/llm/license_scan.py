"""License scan: ordered signature rules over a text's words, in DataFrame functions only.

Rules are regular expressions over the normalised text (its words, joined by one
space). One pattern over the raw text gates the documents, and a literal keyword
gates each rule, so few rules run on few texts. Among the detections a rule of
higher priority, or of the same priority and a longer interval, suppresses what
its interval contains.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, renamed

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, its name as a pattern over words, literals (one of them is in every match), its SPDX words, its address.
LICENSES = (
    ("mit", r"(?:mit|expat) licen[cs]e", "licen", r"mit", r"opensource org licenses mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit no attribution", r"mit 0", r"opensource org licenses mit 0"),
    ("isc", r"isc licen[cs]e", "isc licen", r"isc", r"opensource org licenses isc"),
    ("apache-2.0", r"apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?", "apache", r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e(?: version| v)? 1 1", "apache", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", r"apache", r"apache org licenses"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?v?2(?: 0)?", "general public licen|gpl", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?v?3(?: 0)?", "general public licen|gpl", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl", r"(?:gnu general public licen[cs]e|gnu gpl)", "gnu general public licen|gnu gpl", r"gpl", r"gnu org licenses gpl"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: lgpl)?(?: version| v)? ?v?2 1", "lesser general public licen|lgpl", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: lgpl)?(?: version| v)? ?v?3(?: 0)?", "lesser general public licen|lgpl", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public licen", r"lgpl", r"gnu org licenses lgpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: agpl)?(?: version| v)? ?v?3(?: 0)?", "affero general public licen|agpl", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", r"agpl", r"gnu org licenses agpl"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "free documentation licen", r"gfdl 1 [0-9]", r"gnu org licenses fdl"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", "bsd", r"0bsd", r"opensource org licenses 0bsd"),
    ("bsd", r"(?:berkeley software distribution|bsd) licen[cs]e", "licen", r"bsd", r"opensource org licenses bsd"),
    ("mpl-1.1", r"mozilla public licen[cs]e(?: version| v)? 1 1", "mozilla", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", r"mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", "mozilla", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", r"mpl", r"mozilla org mpl"),
    ("epl-1.0", r"eclipse public licen[cs]e(?: version| v)? 1(?: 0)?", "eclipse", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"eclipse public licen[cs]e(?: version| v)? 2(?: 0)?", "eclipse", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl", r"eclipse public licen[cs]e", "eclipse", r"epl", r"eclipse org legal epl"),
    ("cddl-1.0", r"common development and distribution licen[cs]e", "common development", r"cddl 1 [01]", r"opensource org licenses cddl"),
    ("cpl-1.0", r"common public licen[cs]e", "common public", r"cpl 1 0", r"opensource org licenses cpl"),
    ("ibm-pl", r"ibm public licen[cs]e", "ibm public", r"ipl 1 0", r"opensource org licenses ipl"),
    ("artistic-1.0", r"artistic licen[cs]e(?: version| v)? 1(?: 0)?", "artistic", r"artistic 1 0(?: perl)?", r"perlfoundation org artistic license 1 0"),
    ("artistic-2.0", r"artistic licen[cs]e(?: version| v)? 2(?: 0)?", "artistic", r"artistic 2 0", r"perlfoundation org artistic license 2 0"),
    ("artistic", r"artistic licen[cs]e", "artistic", r"artistic", r"opensource org licenses artistic"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", r"zlib", r"opensource org licenses zlib"),
    ("libpng", r"(?:png reference library|libpng) licen[cs]e", "png reference library|libpng", r"libpng 2 0", r"libpng org pub png src libpng license"),
    ("boost", r"boost software licen[cs]e(?: version| v)?(?: 1 0)?", "boost", r"bsl 1 0", r"boost org license 1 0"),
    ("python", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?", "licen", r"(?:psf|python) 2 0", r"python org psf license"),
    ("php", r"php licen[cs]e(?: version| v)?(?: 3 0(?:1)?)?", "php", r"php 3 0(?:1)?", r"php net license 3 0"),
    ("ruby", r"ruby licen[cs]e", "ruby licen", r"ruby", r"ruby lang org en about license"),
    ("ofl", r"(?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?", "open font", r"ofl 1 1", r"scripts sil org ofl"),
    ("unlicense", r"(?:the unlicense|unlicensed into the public domain)", "unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)", "do what the fuck you want|wtfpl", r"wtfpl", r"wtfpl net"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|to|into) the public domain", "public domain", r"public domain", r"creativecommons org licenses publicdomain"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?: v)?(?: 1 0)?(?: universal)?", "cc0|creative commons zero", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-1.0", r"(?:cc by|creative commons attribution) 1 0", "cc by|creative commons attribution", r"cc by 1 0", r"creativecommons org licenses by 1 0"),
    ("cc-by-2.0", r"(?:cc by|creative commons attribution) 2 [05]", "cc by|creative commons attribution", r"cc by 2 [05]", r"creativecommons org licenses by 2 [05]"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution) 3 0", "cc by|creative commons attribution", r"cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution) 4 0", "cc by|creative commons attribution", r"cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", r"(?:cc by sa|creative commons attribution share ?alike) 3 0", "cc by|creative commons attribution", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", r"(?:cc by sa|creative commons attribution share ?alike) 4 0", "cc by|creative commons attribution", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-3.0", r"(?:cc by nc|creative commons attribution non ?commercial) 3 0", "cc by|creative commons attribution", r"cc by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0", "cc by|creative commons attribution", r"cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", r"(?:cc by nd|creative commons attribution no ?derivatives) 4 0", "cc by|creative commons attribution", r"cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-3.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0", "cc by|creative commons attribution", r"cc by nc sa 3 0", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0", "cc by|creative commons attribution", r"cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 4 0", "cc by|creative commons attribution", r"cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("eupl-1.2", r"european union public licen[cs]e", "european union", r"eupl 1 [0-2]", r"joinup ec europa eu collection eupl"),
    ("osl-3.0", r"open software licen[cs]e(?: version| v)?(?: 3 0)?", "open software licen", r"osl 3 0", r"opensource org licenses osl 3 0"),
    ("afl-3.0", r"academic free licen[cs]e(?: version| v)?(?: 3 0)?", "academic free", r"afl 3 0", r"opensource org licenses afl 3 0"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft public", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal", r"ms rl", r"opensource org licenses ms rl"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", r"postgresql", r"opensource org licenses postgresql"),
    ("openssl", r"openssl licen[cs]e", "openssl", r"openssl", r"openssl org source license"),
    ("x11", r"x11 licen[cs]e", "x11", r"x11", r"xfree86 org 3 3 6 copyright2"),
    ("ncsa", r"university of illinois (?:ncsa )?open source licen[cs]e", "illinois", r"ncsa", r"opensource org licenses ncsa"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e", "database licen", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("pddl-1.0", r"open data commons public domain dedication", "public domain dedication", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("upl-1.0", r"universal permissive licen[cs]e", "universal permissive", r"upl 1 0", r"opensource org licenses upl"),
    ("vim", r"vim licen[cs]e", "vim licen", r"vim", r"vimhelp org uganda"),
    ("ecl-2.0", r"educational community licen[cs]e", "educational community", r"ecl 2 0", r"opensource org licenses ecl2"),
    ("proprietary", r"(?:proprietary and confidential|unauthorized (?:copying|use) .{0,60}prohibited)", "proprietary and confidential|unauthorized", r"licenseref proprietary", r"licenseref proprietary"),
)
#: Longer statements that name no license by themselves.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("no-warranty", r"(?:provided|distributed) (?:on an )?as is(?: basis)? without warrant(?:y|ies)", "as is"),
    ("no-warranty", r"without warranties or conditions of any kind", "conditions of any kind"),
    ("copyright", r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2,4})?", "copyright"),
    ("copyright", r"© (?:19|20)[0-9]{2}", "© "),
    ("reserved", r"some rights reserved", "rights reserved"),
    ("share-alike", r"derivative works must be (?:licensed|distributed) under the same licen[cs]e", "derivative works"),
    ("non-commercial", r"for non ?commercial (?:use|purposes) only", "commercial"),
)
_GRANT = (r"(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|redistribute it)"
          r"(?: and or modify it)? (?:under|by)(?: the| a| an)?(?: terms of)?(?: the)?(?: gnu)? ")
#: Priorities and how far a detection is believed: identifier, grant, address, notice, bare name, base phrase.
P_SPDX, P_GRANT, P_URL, P_NOTICE, P_NAME, P_BASE = 6, 5, 4, 3, 2, 1
BELIEF = {P_SPDX: 0.99, P_GRANT: 0.95, P_URL: 0.9, P_NOTICE: 0.8, P_NAME: 0.7, P_BASE: 0.6}
#: Texts that match none of this hold no detection.
GATE = (r"(?i)licen|reserved|copyright|spdx|domain|warrant|clause|gpl|apache|bsd|commons|unlicense|wtfpl|cc0|prohibited"
        r"|confidential|opensource|permi|©|derivative|commercial|conditions|redistribution|attribution|mozilla|eclipse|joinup|scripts|xfree86|vimhelp|cc" + _GAP + r"by")


def rules() -> list[tuple[str, str, str, int]]:
    """(label, pattern, keywords, priority), first the base phrases, then by falling priority."""
    out = [(label, phrase, phrase, P_BASE) for phrase, label in BASE]
    out += [(lab, rf"spdx license identifier {spdx}", "spdx license identifier", P_SPDX) for lab, _, _, spdx, _ in LICENSES]
    out += [(lab, _GRANT + name, key, P_GRANT) for lab, name, key, _, _ in LICENSES]
    out += [(lab, url, url.split("(")[0].split("[")[0].strip(), P_URL) for lab, _, _, _, url in LICENSES]
    out += [(lab, pat, key, P_NOTICE) for lab, pat, key in NOTICES]
    out += [(lab, name, key, P_NAME) for lab, name, key, _, _ in LICENSES]
    return out


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(words: Column, table: list[tuple[str, str, str, int]]) -> Column:
    """Array of ``s``, ``e`` (words, end exclusive), ``p``, ``rule`` of every rule's
    matches in the padded word string ``words``."""
    listed = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(f"(?<= )(?:{pat})(?= )").alias("re"),
                                F.array(*map(F.lit, keys.split("|"))).alias("keys"), F.lit(p).alias("p"))
                       for i, (_, pat, keys, p) in enumerate(table)])
    gated = F.filter(listed, lambda r: F.exists(r["keys"], lambda k: F.contains(words, k)))
    hits = F.filter(gated, lambda r: F.regexp_like(words, r["re"]))

    def of(r: Column) -> Column:
        parts = F.arrays_zip(F.regexp_extract_all(words, r["re"], F.lit(0)).alias("m"),
                             F.split(words, r["re"], -1).alias("gap"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + _spaces(x["gap"])
            span = F.struct((start - 1).alias("s"), (start + _spaces(x["m"])).alias("e"), r["p"].alias("p"),
                            r["rule"].alias("rule"))
            more = x["m"].isNotNull()
            return F.struct(F.when(more, start + _spaces(x["m"])).otherwise(acc["at"]).alias("at"),
                            F.when(more, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])

    return F.flatten(F.transform(hits, of))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,p:int,rule:int>>")


def unsuppressed(found: Column) -> Column:
    """Detections that lie in no interval of higher priority, nor in a longer or
    earlier listed one of the same: one sweep by start, keeping for each priority
    the furthest end of it or a higher one so far."""
    key = lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), (-x["p"]).alias("np"), x["rule"].alias("rule"))
    ordered = F.array_sort(F.transform(found, key))
    ends = F.array(*[F.lit(-1)] * P_SPDX)

    def step(acc: Column, x: Column) -> Column:
        e, p = -x["ne"], -x["np"]
        hidden = F.element_at(acc["ends"], p) >= e
        now = F.transform(acc["ends"], lambda old, i: F.when((i < p) & (old < e), e).otherwise(old))
        return F.struct(now.alias("ends"), F.when(hidden, acc["out"]).otherwise(F.concat(acc["out"], F.array(
            F.struct(x["s"].alias("s"), e.alias("e"), p.alias("p"), x["rule"].alias("rule"))))).alias("out"))

    return F.aggregate(ordered, F.struct(ends.alias("ends"), _none().alias("out")), step, lambda a: a["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score``, ``detections``.

    Null texts are taken as empty: no words, no detection, score 0, empty
    labels. Repeated rows come back as often as they came; every row stands for
    itself, so ids may repeat or be null. An empty table gives an empty result."""
    table = rules()
    d = renamed(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"     # A-Z are letters here too
    # padded with one space at either end, so that every word stands between spaces
    words = F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), _GAP, " ")
    d = d.select("id", F.regexp_count(text, F.lit(word)).cast("long").alias("n_words"),
                 F.when(text.rlike(GATE), words).alias("words"))
    d = d.withColumn("found", F.when(F.col("words").isNotNull(), detections(F.col("words"), table)).otherwise(_none()))
    d = d.withColumn("kept", F.when(F.size("found") > 1, unsuppressed(F.col("found"))).otherwise(F.col("found")))
    labels = F.array(*[F.lit(r[0]) for r in table])
    name = lambda x: F.element_at(labels, x["rule"] + 1)
    base = F.filter("found", lambda x: x["rule"] < len(BASE))
    base_labels = F.array_sort(F.array_distinct(F.transform(base, name)))
    own = F.transform("kept", name)
    miss = F.aggregate("kept", F.lit(1.0), lambda acc, x: acc * F.element_at(
        F.array(*[F.lit(1 - BELIEF[p]) for p in range(1, P_SPDX + 1)]), x["p"]))
    return d.select(
        F.col("id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["s"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.transform(base, name)))), ",").alias("labels"),
        F.when(F.size("kept") > 0, F.round(1 - miss, 6)).otherwise(0.0).alias("score"),
        F.transform("kept", lambda x: F.struct(name(x).alias("label"), x["s"].alias("first"),
                                               x["e"].alias("end"))).alias("detections"))
