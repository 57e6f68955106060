"""One form for texts that look the same: decomposition, look-alike letters, mark order, recomposition."""

from __future__ import annotations

import sys
import unicodedata as U

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdbook.runtime import cut, hot_keys, salt_all, salt_both, salt_one

#: Letters of other scripts drawn like a Latin letter, by Unicode's notion of confusables.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Greek
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin letters apart
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a",
    # punctuation and signs
    "‐": "-", "‑": "-", "−": "-", "ʼ": "'", "ʹ": "'", "‚": ",", "∶": ":", "꞉": ":", "․": ".", "∕": "/", "⁄": "/", "µ": "μ",
}

#: What joins letters in one character, or widens them: the compatibility forms that look like their parts.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
_INVISIBLE_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_HANGUL = range(0xAC00, 0xD7A4)


def _spread(ch: str) -> str:
    """The character's decomposition, canonical or one that looks the same, all the way down."""
    d = U.decomposition(ch)
    if not d:
        return ch
    tag, _, rest = d.rpartition(">")
    chars = "".join(chr(int(x, 16)) for x in rest.split())
    joined = tag.startswith("<compat") and U.category(ch) in ("Ll", "Lu", "Lt", "Nl", "Lo") and len(chars) > 1 and ch.isprintable()
    if not tag or tag + ">" in _SAME_LOOK or joined:
        return "".join(map(_spread, chars))
    return ch


def mapping_rows(look_alikes: dict[str, str] = LOOK_ALIKES) -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, [(character of its consistent form, combining class)]) for every character that changes or combines.

    Bounded by Unicode: some ten thousand rows, whatever the data. Hangul syllables stay as they are.
    """
    rows = []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = U.category(ch)
        if cat in ("Cn", "Cs", "Co") or cp in _HANGUL:
            continue
        if cat == "Cf" or cp in _INVISIBLE_EXTRA:
            rows.append((ch, []))
        elif cat == "Zs":
            rows.append((ch, [(" ", 0)]))
        elif cat in ("Zl", "Zp") or cp == 0x85:
            rows.append((ch, [("\n", 0)]))
        else:
            to = "".join(look_alikes.get(c, c) for c in _spread(ch))
            if to != ch or U.combining(ch):
                rows.append((ch, [(c, U.combining(c)) for c in to]))
    return rows + [("\r", []), ("\t", [(" ", 0)]), ("\x0b", [(" ", 0)]), ("\x0c", [(" ", 0)])]


def composition_pairs(look_alikes: dict[str, str] = LOOK_ALIKES) -> dict[str, str]:
    """Base and mark -> composed character, for all canonical compositions of two that have a mark in second place."""
    pairs = {}
    for cp in range(0xC0, sys.maxunicode + 1):
        ch = chr(cp)
        d = U.decomposition(ch)
        if d and not d.startswith("<") and cp not in _HANGUL:
            parts = [chr(int(x, 16)) for x in d.split()]
            if len(parts) == 2 and U.combining(parts[1]) and U.normalize("NFC", ch) == ch:
                pairs["".join(look_alikes.get(p, p) for p in parts)] = ch
    for pair, ch in list(pairs.items()):  # of look-alike bases the Latin one wins
        base, mark = pair
        latin = U.normalize("NFC", base + mark)
        if len(latin) == 1:
            pairs[pair] = latin
    return pairs


def _class(chars: list[int]) -> str:
    """A regular expression's character class of these code points."""
    out, at = [], 0
    while at < len(chars):
        end = at
        while end + 1 < len(chars) and chars[end + 1] == chars[end] + 1:
            end += 1
        out.append(f"\\x{{{chars[at]:X}}}" + (f"-\\x{{{chars[end]:X}}}" if end > at else ""))
        at = end + 1
    return "".join(out)


#: Blocks in which characters are told apart one by one; outside of them every character is looked up.
_KNOWN = (range(0x00, 0x180), range(0x400, 0x460), range(0x4E00, 0xA000), _HANGUL)


def _active(rows: list[tuple[str, list[tuple[str, int]]]]) -> str:
    """A short class of the characters that may change: not those of _KNOWN that have no mapping or come back as they were."""
    maps = dict(rows)
    stays = lambda ch: ch not in maps or (maps[ch] and not U.combining(ch) and U.normalize("NFC", "".join(c for c, _ in maps[ch])) == ch)
    return "^" + _class([cp for block in _KNOWN for cp in block if stays(chr(cp))])


def one_form(df: DataFrame, key: str, text: str, out: str = "form", look_alikes: dict[str, str] = LOOK_ALIKES) -> DataFrame:
    """(key, out): each text in its one form; null stays null, '' stays ''. `key` must be unique.

    Texts that hold no character that may change are their own form and pass by. In the others, stretches of such
    characters stay whole and the rest is exploded to positioned code points. These are joined with the (broadcast,
    Unicode-bounded) table of decompositions and look-alikes; combining marks are put behind their base in the order of
    combining classes; base and marks are composed where Unicode has a composed letter; the text is rebuilt by position.
    Only texts are shuffled, to group by key; all later steps keep that partitioning.
    `look_alikes` (character -> what it looks like) is a parameter: the default knows Cyrillic, Greek, some Armenian letters
    and punctuation; a longer table, such as Unicode's confusables, can be given. Blanks of any kind become U+0020, one for one; invisible characters and carriage returns vanish; line feeds stay.
    Superscripts, fractions, circled and mathematical letters look different and are left alone, as are Hangul jamo.
    """
    return _forms(df, key, text, out, look_alikes).drop("_m").withColumnRenamed("_k", key)


def _forms(df: DataFrame, key: str, text: str, out: str, look_alikes: dict[str, str]) -> DataFrame:
    """(_k, out, _m): one_form's texts, with a hash of the text as it was."""
    rows = mapping_rows(look_alikes)
    active = _active(rows)
    docs = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    spelling = F.md5("_t").alias("_m")
    inert = active[1:]
    plain = r"[\n -~]"  # always inert, and tested by one comparison
    changes = F.coalesce(~F.col("_t").rlike(rf"\A(?:{plain}++|[{inert}])*+\z"), F.lit(False))
    # a piece: characters that may change with the one before them, or a stretch that can't
    pieces = F.regexp_extract_all("_t", F.lit(f"[{inert}]?[{active}]++|(?:{plain}(?={plain})|[{inert}](?![{active}]))++"), F.lit(0))
    split = F.transform(pieces, lambda p: F.when(F.right(p, F.lit(1)).rlike(f"[{active}]"), F.split(p, "")).otherwise(F.array(p)))
    points = docs.where(changes).repartition("_k").select("_k", F.posexplode(split).alias("_piece", "_cs")).select("_k", "_piece", F.posexplode("_cs").alias("_pos", "_c"))
    table = df.sparkSession.createDataFrame(rows, "_from string, _to array<struct<c:string,cc:int>>")
    to = F.coalesce("_to", F.array(F.struct(F.col("_c").alias("c"), F.lit(0).alias("cc"))))
    points = points.join(F.broadcast(table), F.col("_c") == F.col("_from"), "left").select("_k", "_piece", "_pos", F.posexplode(to).alias("_i", "_to"))
    points = points.select("_k", "_piece", "_pos", "_i", "_to.c", "_to.cc")
    order = W.partitionBy("_k", "_piece").orderBy("_pos", "_i")
    points = points.withColumn("_at", F.sum((F.col("cc") == 0).cast("int")).over(order))
    clusters = points.groupBy("_k", "_piece", "_at").agg(
        F.coalesce(F.max(F.when(F.col("cc") == 0, F.col("c"))), F.lit("")).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("cc") > 0, F.struct("cc", "_pos", "_i", "c")))).alias("marks"))
    whole = F.when(F.size("marks") == 0, F.col("base")).otherwise(_composed(F.col("base"), F.col("marks"), look_alikes))
    built = clusters.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_piece", "_at", whole.alias("s")))).alias("a"))
    built = docs.where(changes).select("_k", spelling).join(built, "_k", "left").select("_k", F.coalesce(F.array_join(F.transform("a", lambda x: x.s), ""), F.lit("")).alias(out), "_m")
    return docs.where(~changes).select("_k", F.col("_t").alias(out), spelling).unionByName(built)


def _composed(base: Column, marks: Column, look_alikes: dict[str, str]) -> Column:
    """A base and its ordered marks, composed: each mark that isn't blocked joins the base if there is a composed letter."""
    pairs = F.create_map(*(F.lit(x) for kv in sorted(composition_pairs(look_alikes).items()) for x in kv))

    def step(a: Column, m: Column) -> Column:
        made = F.when((a.rest == "") | (a.last < m.cc), F.try_element_at(pairs, F.concat(a.base, m.c)))
        return F.struct(F.coalesce(made, a.base).alias("base"), F.when(made.isNull(), F.concat(a.rest, m.c)).otherwise(a.rest).alias("rest"), F.when(made.isNull(), m.cc).otherwise(a.last).alias("last"))

    end = F.aggregate(marks, F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last")), step)
    return F.concat(end.base, end.rest)


def looks(df: DataFrame, key: str, text: str, look_alikes: dict[str, str] = LOOK_ALIKES) -> tuple[DataFrame, DataFrame]:
    """(members: key, look, spelling; links: look, spelling_a, spelling_b) of the texts that occur in several spellings of one form.

    look and spelling are hashes of the form and of the text as it is; identical texts are one spelling. Null and blank texts
    take no part.
    """
    forms = _forms(df, key, text, "_form", look_alikes).where(F.trim("_form") != "").select(F.col("_k").alias(key), F.sha2("_form", 256).alias("look"), F.col("_m").alias("spelling"))
    forms = cut(forms)  # hashes only
    mixed = forms.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("look")
    members = cut(forms.join(mixed, "look", "left_semi").select(key, "look", "spelling"))
    each = members.select("look", "spelling").distinct()
    a, b = salt_both(each.withColumnRenamed("spelling", "spelling_a"), each.withColumnRenamed("spelling", "spelling_b"), ["look"], F.col("spelling_a"), F.col("spelling_b"))
    return members, a.join(b, ["look", "_salt"]).where("spelling_a < spelling_b").select("look", "spelling_a", "spelling_b")


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b): pairs whose texts have the same form but aren't the same string, the smaller key first.

    The links of `looks`, spelled out for rows; frequent spellings are salted. Null and blank texts take no part.
    """
    members, links = looks(df, key, text)
    hot = cut(hot_keys(members, ["spelling"]))
    one = lambda s: members.select(F.col(key).alias(f"_{s}"), F.col("spelling").alias(f"spelling_{s}"))
    for s in "ab":
        by, h = [f"spelling_{s}"], hot.withColumnRenamed("spelling", f"spelling_{s}")
        links = salt_all(links, h, by).join(salt_one(one(s), h, by, F.col(f"_{s}")), [*by, "_salt"]).drop("_salt")
    return links.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"))
