"""The same postal address written differently: numbers first, then rare words."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.runtime import cut, hot_keys, salt_all, salt_both, salt_one

# Words of addresses, with accents and doubled vowels folded as fold() does.
COUNTRIES = """italia italy italien italie deutschland germany allemagne germania alemania france frankreich francia frankrijk espana spain spanien espagne spagna
schweiz suisse svizzera switzerland suiza austria osterreich autriche norge norway norwegen noruega norvege newzealand neuseland aotearoa nederland netherlands
niederlande holland""".split()
COUNTRY_CODES = "it de fr es ch at no nz nl".split()
#: Street types that are words of their own: spelling -> type.
TYPES = {
    "via": "via", "v.": "via", "viale": "vle", "v.le": "vle", "vle": "vle", "corso": "cso", "c.so": "cso", "cso": "cso", "piazza": "pza", "p.za": "pza", "p.zza": "pza", "pza": "pza", "pza.": "pza",
    "plaza": "pza", "pl.": "pza", "calle": "calle", "c/": "calle", "c.": "calle", "avenida": "av", "av.": "av", "av": "av", "avda.": "av", "avda": "av", "paseo": "paseo", "pº": "paseo", "p.º": "paseo", "pso.": "paseo", "pso": "paseo",
    "rue": "rue", "r.": "rue", "avenue": "av", "ave": "av", "ave.": "av", "boulevard": "bd", "bd": "bd", "bd.": "bd", "boul.": "bd", "boul": "bd", "blvd": "bd", "chemin": "chemin", "ch.": "chemin", "chem.": "chemin", "chem": "chemin",
    "road": "rd", "rd": "rd", "rd.": "rd", "street": "st", "st": "st", "st.": "st", "lane": "ln", "ln": "ln", "ln.": "ln",
}
#: Street types at the end of a word: spelling -> type, longest first.
ENDINGS = [("strasse", "str"), ("strase", "str"), ("strat", "str"), ("str.", "str"), ("str", "str"), ("gasse", "gs"), ("gase", "gs"), ("weg", "wg"), ("wg.", "wg"), ("wg", "wg"), ("g.", "gs"), ("platz", "pl"), ("plassen", "pl"), ("plass", "pl"), ("plein", "pl"), ("pln.", "pl"), ("pln", "pl"), ("pl.", "pl"), ("pl", "pl"),
           ("lan", "ln"), ("ln.", "ln"), ("ln", "ln"), ("gata", "gt"), ("gt.", "gt"), ("gt", "gt"), ("veien", "vn"), ("vn.", "vn"), ("vn", "vn"), ("v.", "vn"), ("baken", "bk"), ("bakken", "bk"), ("bkn.", "bk"), ("bkn", "bk"), ("bk.", "bk")]
SMALL_WORDS = set("de del des du d di dei da la le los las el il lo sur les am im an der van y e".split())
_UNIT = re.compile(r"""\b(?:scala|batiment|bat\.|inngang|interno|int\.|local|unit|level|piano|suite|apt\.?|puerta|flor)\s*(?:\d{1,5}|[a-z])\b
|\b(?:postfach|case\spostale|casella\spostale|apartado|p\.?o\.?\sbox|postboks|postbus)\b(?:\s*\d{1,3}\b)?
|\b\d{1,2}\s?(?:º|°|ª|er|eme|e|o|\.)?\s*(?:piso|etage|og|stock|etasje|flor|verdieping|piano)\b|\bhinterhaus\b|\bvorderhaus\b|\bbegane\sgrond\b|\bbajo(?:\s(?:izq|dcha)\b\.?)?|\berdgeschoss\b""", re.X)
_CODE = re.compile(r"(?<![\w])(?:(?:d|a|ch|f|i|e|n|nl|nz|at|de|fr|it|es|no)-|nz\s)?(\d{4,5})(?:\s?([a-z]{2})(?![\w.]))?(?!\w)")
_NUMBER = re.compile(r"(?:\b(?:nr|no|num|n)\s?[.º°]?\s*|[n]\s?[º°]\s*)?(?<![\w])(\d{1,4})(?:([a-z])(?!\w)|\s([a-h])(?![\w'’./]))?(?!\w)")


def fold(text: str) -> str:
    """Lower case without accents; ae, oe, ue and doubled vowels like a, o, u, so that umlauts in any spelling are one."""
    text = text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "a").replace("º", "°")
    text = "".join(c for c in U.normalize("NFKD", text) if not U.combining(c))
    return re.sub(r"aa|ae", "a", text.replace("oe", "o").replace("ue", "u").replace("oo", "o").replace("ee", "e"))


_TYPES = {fold(k): v for k, v in TYPES.items()}
_COUNTRIES = {fold(c) for c in COUNTRIES}


def parse(address: str | None, plz: str | None, town: str | None) -> tuple[str, str, str, list[str], list[str]] | None:
    """(house number with its letter, postal code, street types, words, words given as the town); None if there is no address."""
    text = re.sub(r"new\s+zealand", "newzealand", fold(address or ""))
    if not re.search(r"\d", text) or not re.search(r"[^\W\d_]{2}", text):
        return None
    text = _UNIT.sub(" , ", re.sub(r"\s*\n\s*|\s+-\s+|;", " , ", text))
    code, towns = "", []
    given = re.match(r"\s*(?:[a-z]{1,2}-)?(\d{4,5})", fold(plz or ""))
    found = list(_CODE.finditer(text))
    if given:
        code = given[1]
        found = [m for m in found if m[1] == code]
    if found:
        m = found[-1]
        code = m[1]
        after = [w for w in re.split(r"[^\w]+", text[m.end():]) if w]
        before = text[: m.start()].split(",")
        if not m[2] and not after or all(w in _COUNTRIES or w in COUNTRY_CODES for w in after):
            after = [] if re.search(r"\d", before[-1]) else [w for w in re.split(r"[^\w]+", before[-1]) if w]
        towns = [] if re.search(r"\d", " ".join(after)) else after
        text = f"{text[: m.start()]} , {text[m.end():]}"
    # country: a name anywhere, a code as the last word or alone between commas
    text = re.sub(r"(?:^|,)\s*(?:" + "|".join(COUNTRY_CODES) + r")\s*(?=,|$)", " , ", text)
    text = re.sub(r"\s(?:" + "|".join(COUNTRY_CODES) + r")\s*$", " ", text.rstrip(" ,"))
    m = _NUMBER.search(text)
    if not m:
        return None
    number = m[1].lstrip("0") + (m[2] or m[3] or "")
    text = f"{text[: m.start()]} , {text[m.end():]}"
    text = re.sub(r"\b(?:nr|no|num|n)\s?[.°]|\bn°", " ", text)
    text = re.sub(r"-(?=(?:strasse|strase|str|gasse|gase|weg|wg|platz|pl)\b)", "", text)
    types, words = set(), []
    for raw in re.split(r"[\s,()]+", text):
        if not raw or raw in _COUNTRIES:
            continue
        if raw in _TYPES:
            types.add(_TYPES[raw])
            continue
        for end, kind in ENDINGS:
            if raw.endswith(end) and len(raw) - len(end) >= 4 and not (end.startswith("pln") and raw.endswith("kamp" + end[1:])):
                types.add(kind)
                raw = raw[: -len(end)]
                break
        words += [w for w in re.split(r"[^\w]+", raw) if w and w not in _COUNTRIES]
    column = [w for w in re.split(r"[^\w]+", fold(town or "")) if w and not w.isdigit() and w not in ("nan", "none", "null")]
    towns = column or towns
    words += column
    return number, code, " ".join(sorted(types)), sorted({w for w in words if w not in SMALL_WORDS and len(w) > 1}), sorted({w for w in towns if w not in SMALL_WORDS and w not in _COUNTRIES and len(w) > 1})


def parsed(df: DataFrame, key: str, address: str, plz: str, town: str) -> DataFrame:
    """(key, number, code, types, words, towns) of each row that holds an address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, *p) for k, a, c, t in zip(b["k"], b["a"], b["c"], b["t"]) if (p := parse(a, c, t))]
            yield pd.DataFrame(got, columns=["key", "number", "code", "types", "words", "towns"])

    kind = dict(df.dtypes)[key]
    text = lambda c, n: F.col(c).cast("string").alias(n)
    return df.select(F.col(key).alias("k"), text(address, "a"), text(plz, "c"), text(town, "t")).mapInPandas(run, f"key {kind}, number string, code string, types string, words array<string>, towns array<string>")


def _close(a: Column, b: Column) -> Column:
    """True for two words that differ by a typo: one letter, two in longer words, or two letters swapped."""
    d = F.levenshtein(a, b, 2)
    letters = lambda x: F.array_sort(F.split(x, ""))
    short = F.least(F.length(a), F.length(b))
    return ((d == 1) & (short >= 4)) | ((d == 2) & ((short >= 6) | ((short >= 3) & (letters(a) == letters(b))))) | ((d == 1) & (short == 3) & (letters(a) != letters(b)))


def _two_words(a: Column, b: Column) -> Column:
    """True if two spellings are both too frequent for one to be a typo of the other."""
    return (F.least(a, b) >= 3) & (F.least(a, b) * 20 > F.greatest(a, b))


def places(df: DataFrame, key: str, address: str, plz: str, town: str, accept: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members: key, class; links: class_a, class_b, score): the spellings of addresses, and those that denote one location.

    Addresses are cut into house number with its letter, postal code, street type and words; floors, units, buildings,
    boxes and countries are left out. Records that say the same become one class (also
    where nothing says which town it is in). Classes are blocked numbers first, so that every pair which can be accepted meets: those with a
    postal code on both sides by house number and digit tokens (the code's sorted digits, and the code without one digit);
    those with none on a side by house number and any one word; words that occur once also meet with a letter left out. So
    a pair is only missed if no code stands on a side and each of its words is misspelt in a frequent way. In a block,
    array_intersect gives the common words, levenshtein matches the rest. Two classes are the same place if the street types
    agree, no word is left on both sides, the postal codes agree or (where one is missing) the towns do, and the
    rarity-weighted share of matched words reaches `accept`. A record's missing town is known through its postal code where
    other records give both. A rare short word that is one letter from an article or preposition is taken for that. Word counts cover all rows; hot words, blocks and classes are salted.
    """
    rows = cut(parsed(df, key, address, plz, town).withColumn("class", F.md5(F.concat_ws("|", "number", "code", "types", F.concat_ws(" ", "words")))))
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("number").alias("number"), F.first("code").alias("code"), F.first("types").alias("types"), F.first("words").alias("words"), F.max("towns").alias("towns"))
    # towns by postal code: those that a third of its records give
    by_code = rows.where((F.col("code") != "") & (F.size("towns") > 0)).groupBy("code", F.concat_ws(" ", "towns").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    total = by_code.groupBy("code").agg(F.sum("n").alias("all"))
    implied = by_code.join(total, "code").where("n * 3 >= all AND n >= 2").groupBy("code").agg(F.collect_set("t").alias("implied"))  # three at most
    classes = cut(classes.join(implied, "code", "left"))
    # rarity of words, and whether a word is a town's
    words = classes.select("class", "n", F.explode("words").alias("w"), "towns")
    stats = words.groupBy("w").agg(F.sum("n").alias("df"), (F.sum(F.when(F.array_contains("towns", F.col("w")), F.col("n")).otherwise(0)) / F.sum("n")).alias("town"))
    n_all = max(1, rows.count())
    hot = hot_keys(words, ["w"])
    letters = lambda x: F.array_sort(F.split(x, ""))
    one_off = lambda x: (F.levenshtein(F.col("w"), F.lit(x)) <= 1) | (letters(F.col("w")) == letters(F.lit(x)))
    slip = (F.length("w") <= 4) & (F.col("df") * 1000 <= n_all + 1000) & reduce(lambda a, b: a | b, (one_off(x) for x in sorted(SMALL_WORDS) if len(x) > 1))
    stats = stats.select("w", F.struct("w", F.log(F.lit(1.0 + n_all) / F.col("df")).alias("weight"), (F.col("town") > 0.4).alias("town"), "df", slip.alias("slip")).alias("x"))
    weighed = salt_one(words.select("class", "w"), hot, ["w"], F.col("class")).join(salt_all(stats, hot, ["w"]), ["w", "_salt"]).groupBy("class").agg(F.collect_list("x").alias("ws"))
    classes = cut(classes.drop("n", "words", "towns").join(weighed, "class"))
    keyed = lambda s, bare, rest: _keyed(classes, bare, rest).select(F.col("class").alias(f"class_{s}"), "block")
    a, b = salt_both(keyed("a", "u", "v"), keyed("b", "uv", "u"), ["block"], F.col("class_a"), F.col("class_b"), 2_000)
    met = a.join(b, ["block", "_salt"]).where("class_a <> class_b")
    pairs = met.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()
    side = lambda s: classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("class", "number", "code", "types", "ws", "implied")))
    links = _judged(pairs.join(side("a"), "class_a").join(side("b"), "class_b").where("number_a = number_b")).where(F.col("same") & (F.col("score") >= accept)).select("class_a", "class_b", "score")
    return rows.select("key", "class"), cut(links)


def _keyed(classes: DataFrame, bare: str, rest: str) -> DataFrame:
    """(class, block). Word blocks end in a letter that says whether the class has a postal code: `bare` and `rest` are the
    letters written by those without and with one, so that two classes with codes don't meet by their words."""
    digits = lambda x: F.concat_ws("", F.array_sort(F.split(x, "")))
    less = F.transform(F.sequence(F.lit(1), F.length("code")), lambda i: F.concat(F.lit("-"), F.substring(F.col("code"), F.lit(1), i - 1), F.substring(F.col("code"), i + 1, F.length("code"))))
    none = F.array().cast("array<string>")
    coded = F.when(F.col("code") != "", F.concat(F.array(F.concat(F.lit("="), digits(F.col("code"))), F.concat(F.lit("-"), F.col("code"))), less)).otherwise(none)
    typo = lambda x: F.when(x.df == 1, F.transform(F.sequence(F.lit(1), F.length(x.w)), lambda i: F.concat(F.substring(x.w, F.lit(1), i - 1), F.substring(x.w, i + 1, F.length(x.w))))).otherwise(none)
    said = F.concat(F.transform("ws", lambda x: x.w), F.flatten(F.transform("ws", typo)), F.flatten(F.transform(F.coalesce("implied", none), lambda t: F.split(t, " "))))
    mark = F.when(F.col("code") == "", F.array(*map(F.lit, bare))).otherwise(F.array(*map(F.lit, rest)))
    worded = F.flatten(F.transform(said, lambda w: F.transform(mark, lambda m: F.concat(w, F.lit(" "), m))))
    return classes.select("class", F.explode(F.array_distinct(F.concat(coded, worded))).alias("b"), "number").select("class", F.xxhash64("number", "b").alias("block"))


def same_address(df: DataFrame, key: str, address: str, plz: str, town: str, accept: float = 0.7) -> DataFrame:
    """(key_a, key_b, score): pairs of records that denote the same street, house number and town, the smaller key first.

    The pairs of `places`, spelled out for records: all of one class, and across two that are linked. `key` must be unique.
    Rows that hold no address (null, blank, without number) take no part. Frequent classes are salted.
    """
    members, links = places(df, key, address, plz, town, accept)
    one, two = members.select(F.col("key").alias("ka"), F.col("class").alias("class_a")), members.select(F.col("key").alias("kb"), F.col("class").alias("class_b"))
    hot = cut(hot_keys(one, ["class_a"]))
    left = salt_one(one, hot, ["class_a"], F.col("ka")).join(salt_all(links, hot, ["class_a"]), ["class_a", "_salt"]).drop("_salt")
    hot_b = hot.withColumnRenamed("class_a", "class_b")
    across = salt_all(left, hot_b, ["class_b"]).join(salt_one(two, hot_b, ["class_b"], F.col("kb")), ["class_b", "_salt"]).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "score")
    a, b = salt_both(one, two.withColumnRenamed("class_b", "class_a"), ["class_a"], F.col("ka"), F.col("kb"))
    within = a.join(b, ["class_a", "_salt"]).where("ka < kb")
    return across.unionByName(within.select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), F.lit(1.0).alias("score")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator, into which the optimizer doesn't copy what is read from it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _judged(both: DataFrame) -> DataFrame:
    """Pairs of classes with `same` and `score`. Tests of types and codes, which need no words, come first."""
    names = lambda x: F.transform(x, lambda w: w.w)
    has = lambda s: F.col(f"code_{s}") != ""
    two_codes = has("a") & has("b")
    sorted_code = lambda s: F.array_sort(F.split(f"code_{s}", ""))
    near_code = (sorted_code("a") == sorted_code("b")) | (F.levenshtein("code_a", "code_b") <= 1)
    types = F.arrays_overlap(F.split("types_a", " "), F.split("types_b", " ")) | (F.col("types_a") == "") | (F.col("types_b") == "")
    both = both.where(types & (~two_codes | (F.col("code_a") == F.col("code_b")) | near_code))
    both = _once(both, common=F.array_intersect(names(F.col("ws_a")), names(F.col("ws_b"))))
    rest = lambda s: F.filter(f"ws_{s}", lambda x: ~F.array_contains("common", x.w))
    both = _once(both, rest_a=rest("a"), rest_b=rest("b"))
    match = lambda x, other: F.exists(f"rest_{other}", lambda y: _close(x.w, y.w) & ~_two_words(x.df, y.df))
    both = _once(both, left_a=F.filter("rest_a", lambda x: ~x.slip & ~match(x, "b")), left_b=F.filter("rest_b", lambda x: ~x.slip & ~match(x, "a")))
    matched = lambda s: F.filter(f"ws_{s}", lambda x: ~F.exists(f"left_{s}", lambda y: y.w == x.w))
    both = _once(both.where((F.size("left_a") == 0) | (F.size("left_b") == 0)), got_a=matched("a"), got_b=matched("b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.weight)
    town_met = F.exists("got_a", lambda x: x.town) | F.exists("got_b", lambda x: x.town)
    street_met = (F.size(F.filter("got_a", lambda x: ~x.town)) > 0) | (F.size(F.filter("got_b", lambda x: ~x.town)) > 0)
    codes = (F.col("code_a") == F.col("code_b")) | (near_code & town_met)
    # a town on one side only that the other side's postal code stands for
    stands = lambda s, o: F.exists(F.coalesce(f"implied_{s}", F.array().cast("array<string>")), lambda t: (F.size(F.array_intersect(F.split(t, " "), names(F.col(f"ws_{o}")))) == F.size(F.split(t, " "))))
    through = (~has("b") & stands("a", "b")) | (~has("a") & stands("b", "a"))
    where = (two_codes & codes) | (~two_codes & (town_met | through))
    n_a, n_b = F.size("left_a"), F.size("left_b")
    towns_of = lambda s: F.exists(f"ws_{s}", lambda x: x.town)
    # words left on one side only are its town: the other side must have none, and the place be known otherwise
    excess = lambda s, o: (F.size(f"left_{o}") == 0) & ~towns_of(o) & ((two_codes & codes) | through)
    words = ((n_a == 0) & (n_b == 0)) | ((n_a > 0) & excess("a", "b")) | ((n_b > 0) & excess("b", "a"))
    # of each side, the rarity-weighted share of words met; one met by levenshtein only counts three quarters
    exact = lambda s: F.filter(f"got_{s}", lambda x: F.array_contains("common", x.w))
    share = lambda s: (0.75 * total(f"got_{s}") + 0.25 * total(exact(s))) / F.greatest(F.lit(1e-9), total(f"ws_{s}"))
    return _once(both.where(where & words & street_met), same=F.lit(True), score=F.greatest(share("a"), share("b")))
