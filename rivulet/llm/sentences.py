"""Sentence units of texts in any language and script, in SQL expressions only.

Method: marks that end nothing (in numbers, list numbers, dates, initials,
abbreviations, addresses, file names, and in quotations that are part of a
longer sentence) are masked, each kind by a private-use placeholder of its own
and of the same length; a boundary is put after each sentence mark that is left,
with the quotes and brackets that close there, after each line break, and in
Thai after blanks; the pieces between boundaries, their marks restored, less the
blanks around, are the units.

Rules are given for English, German, French, Spanish, Russian, Greek, Arabic,
Hindi, Chinese, Japanese and Thai; other languages get the marks of their
script and the general rules for numbers, initials and quotations. Private-use
characters of the text that are placeholders here come back as �.

UTF-8 that was read as Windows-1252 is judged as the text that was meant; its
units have the positions of the garbled text, in which every byte is one code
point.

A null or empty text has no units, nor has one of blanks only. Repeated rows
give repeated units. Very long texts and lines are worked through in time
proportional to their length: quotations are judged once each, and no text is
walked through from its start for a unit. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, FLAG = "\ue0ff", "\ue0fe"
BLANKS = " \t\r\n\x0b\x0c\x85\xa0            ​    　﻿"
GAP = r"[ \t\x{a0}\x{202f}]"
MARKS = r".!?…。！？｡؟।॥۔‼⁇⁈⁉։።။។།"
#: Each mark's placeholder, and the characters that stand for the two Greek question marks.
PLACE = {m: chr(0xE000 + k) for k, m in enumerate(MARKS)}
GREEK = {";": "\ue0f0", "\u037e": "\ue0f1"}
HELD = "".join(PLACE.values()) + "".join(GREEK.values()) + FLAG + CUT
MARKS += "".join(GREEK.values())
#: One of them; the range that comes first turns letters of European scripts away at once.
MARK = rf"[[.!?\x{{589}}-\x{{ff61}}]&&[{MARKS}]]"
#: What parts quoted text from the text around.
QUOTES = "\n«»“”„「」『』"
#: What an abbreviation or initial can't follow directly; it can follow a character of a script without spaces.
INSIDE = r"[[\p{L}\p{M}\p{N}]&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"

#: Abbreviations that never end a sentence.
TITLES = (
    "Mr Mrs Ms Messrs Dr Drs Prof Gen Lt Capt Rev Col Maj Sgt Cpl Cmdr Adm Sen Gov Hon Pres St Ste vs cf approx incl viz esp "
    "Hr Hrn Fr Frl Fa ca bzw vgl Vgl inkl zzgl evtl ggf sog geb Dipl Ing "
    "MM Mlle prof bd av env chap éd Sr Sra Srta Dra Dña Avda Gral Lic aprox Sig Dott "
    "ул им Проф проф акад см См рис Рис стр гл тыс млн млрд "
    "Βλ βλ σελ κεφ αρ δρ Δρ κ κα κος καθ τηλ "
    "कि ग्रा मी से डॉ प्रो रु मि नं पृ"
).split()
#: Abbreviations that end no sentence before a number.
BEFORE_NUMBER = (
    "No Nos no nos Fig Figs fig p P pp S Sec sec Ch ch Vol vol Art art Eq eq Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "Nr Abb Abschn Kap Bd Abs Tab Str str pág págs Pág núm Núm cap h ft lb s с д кв корп т п ст N"
).split()
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jh|Jahrhunderts?"
ARTICLES = "der|die|das|dem|den|des|am|im|vom|zum|zur|beim|seit|jeder|jede|jedes|dieser|diesem|ins|einem|einer"
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun|EST|GMT|UTC|CET|PST"
#: What follows a quotation that is part of a longer sentence, in languages without letter case, and names before the verb in English.
SPEECH = (
    rf"{GAP}*+(?:سأل|سألت|قال|قالت|صاح|صاحت|هتف|هتفت|أجاب|أجابت|رد|ردت|أضاف|أضافت|همس|همست|تساءل|تساءلت)(?!\p{{L}})"
    rf"|{GAP}*+[\p{{IsDevanagari}}&&[^।॥]]++(?:{GAP}(?!ने{GAP})[\p{{IsDevanagari}}&&[^।॥]]++)?{GAP}ने{GAP}(?:पूछा|कहा|बताया|बोला|पुकारा|जवाब|उत्तर|लिखा)"
    rf"|{GAP}*+(?:कहकर|कहा|पूछा|बोला|बोली)(?![\p{{L}}\p{{M}}])"
    r"|(?:他|她|它|我|你|您|我们|他们|她们|人们)(?:[轻低大小高]声)?(?:地)?(?:说|问|喊|答|叫|想|写|回答|补充|解释)|\p{IsHan}{1,4}(?:说道|问道|喊道|答道|叫道|写道)"
    r"|(?:と|って|は|が|を|に|の|へ|も|や|から|まで|など)(?=[\p{IsHan}\p{IsKatakana}\p{N}、，言])"
    rf"|{GAP}+\p{{Lu}}\p{{L}}+{GAP}(?:said|asked|shouted|replied|cried|answered|whispered|wrote|called)(?!\p{{L}})"
)
GOES_ON = rf"[,;:،、，；：؛{MARKS}]|{GAP}*+[—–-]|{GAP}*+\p{{Ll}}(?!\p{{Lu}})|{SPEECH}"
QUOTE_GOES_ON = rf"(?=[”»」』]|“(?!\p{{L}}))(?:.(?:{GOES_ON}))"
CLOSE = r"(?:[ \x{a0}\x{202f}]?[»›]|[”’)）\]］」』】》〉＂]|[“\"'](?!\p{L})|�(?![\p{L}\p{N}])| �(?= \p{Ll}))"


def _words(words: list[str]) -> str:
    """Also with � for a letter outside ASCII of a Latin word, as a false charset leaves it."""
    lost = {re.sub(r"[^\x00-\x7f]", "�", w) for w in words if re.search("[a-zA-Z]", w)}
    return "|".join(sorted({*words, *lost}, key=lambda w: (-len(w), w)))


#: Full stops that end nothing. The stop comes first in the pattern and what precedes it is looked up from there, so all other characters are passed over quickly.
STOPS = (
    # numbers; names of files, hosts and versions; a hyphen after an initial
    r"(?<=\p{N}\.)(?=\p{N})|(?<![\p{L}\p{N}.]\.)(?=\p{N})|(?<=[\p{L}\p{N}_-]\.)(?=\p{Ll}(?!\p{Lu}{2})|\p{N}|_)|(?=-\p{L})",
    # list numbers belong to their sentence
    rf"(?<=(?:^|[\r\n]){GAP}{{0,8}}[(\[]?(?:\p{{N}}{{1,3}}|\p{{L}})\.)(?={GAP})",
    # dates and ordinals
    rf"(?<=(?<!\p{{N}})\p{{N}}{{1,2}}\.)(?={GAP}\p{{N}}{{1,2}}\.{GAP}?\p{{N}}|{GAP}(?:{MONTHS})(?!\p{{L}}))",
    rf"(?={GAP}\p{{N}}{{4}})(?<=(?<!\p{{N}})\p{{N}}{{1,2}}\.{GAP}\p{{N}}{{1,2}}\.)",
    rf"(?={GAP}\p{{L}})(?<=(?<!\p{{L}})(?i:{ARTICLES}){GAP}\p{{N}}{{1,3}}\.)",
    # abbreviations
    rf"(?<=(?<!{INSIDE})(?:{_words(TITLES)})\.)",
    rf"(?={GAP}*+\p{{N}})(?:(?<=(?<!{INSIDE})(?:{_words(BEFORE_NUMBER)})\.)|(?<=\p{{L}}str\.))",
    # initials, also of letters without case, and abbreviations of several letters
    rf"(?<=(?<!{INSIDE})(?:\p{{Lu}}|[\p{{IsArabic}}&&\p{{L}}]|[\p{{IsDevanagari}}&&\p{{L}}]\p{{M}}{{0,2}})\.)(?<![πμ]\.Χ\.)(?=\S|{GAP})",
    rf"(?={GAP}?\p{{L}}\.)(?<=(?<!{INSIDE})\p{{Ll}}\.)",
    rf"(?={GAP}(?:{WEEKDAYS})(?!\p{{L}}))(?<=\.{GAP}?[mM]\.)",
)

#: (needed for it to matter, pattern, replacement), in this order.
MASKS: list[tuple[str | None, str, str]] = [
    # a Greek question mark
    *[(g, rf"{g}(?<=[\x{{370}}-\x{{3ff}}\x{{1f00}}-\x{{1fff}}][»”\"’)]?{g})" if g == ";" else g, held) for g, held in GREEK.items()],
    (None, rf"\.(?:{'|'.join(STOPS)})", PLACE["."]),
    *[(rf"{mark}(?=[\p{{Ll}}\p{{N}}]++[=&])",) * 2 + (PLACE[m],) for m, mark in (("?", "[?]"), ("!", "!"))],
    # an ellipsis between two clauses of a Chinese sentence; in Japanese after a word that can't end one
    *[
        (mark, pattern.replace("MARK", mark), PLACE["…"] * len(mark))
        for mark in ("……", "…")
        for pattern in (
            r"MARK(?=\p{IsHan}[^，、。！？\n…]*+(?:[。！？\n]|$))(?<=(?:^|[。！？\n”」』）])[ 　]{0,2}\p{IsHan}{1,40}MARK)",
            r"MARK(?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]MARK)(?<=[\p{IsHiragana}\p{IsKatakana}][^\n。！？]{0,3}MARK)(?<![すただいうくつむぬるん…]MARK)",
        )
    ],
    # a remark in brackets within a sentence
    *[(f"{m}）", rf"（(?<=[^\s。！？!?.…」』）”]（)([^（）\n。！？]*+){m}）", f"（$1{PLACE[m]}）") for m in "。！？"],
]


def masked(text: Column) -> Column:
    """The text with every mark that ends nothing replaced by its placeholder; of the same length."""
    t = F.translate(text, HELD, "�" * len(HELD))
    for need, pattern, replacement in MASKS:
        t = _where(t, need, pattern, replacement)
    return _let(t, lambda s: F.when(s.rlike(QUOTE_GOES_ON), _quotations(s)).otherwise(s))


def _quotations(text: Column) -> Column:
    """Masks the marks of quotations that are part of a longer sentence; one right before their end is judged with what follows.

    Every closing quote the sentence goes on from is flagged once, and of the
    text before a flag the part since the last quote or line break is masked.
    """
    last = FLAG * len(QUOTES)
    marks, places = "".join(PLACE), "".join(PLACE.values())

    def inner(piece: Column) -> Column:
        size = F.length(F.substring_index(F.translate(piece, QUOTES, last), FLAG, -1))
        head, tail = F.substring(piece, F.lit(1), F.length(piece) - size), F.right(piece, size)
        return F.when(size > 1, F.concat(head, F.translate(F.substring(tail, F.lit(1), size - 1), marks, places), F.right(tail, F.lit(1)))).otherwise(piece)

    flagged = F.split(F.regexp_replace(text, rf"(?={QUOTE_GOES_ON})", FLAG), FLAG)
    return _let(flagged, lambda parts: F.array_join(F.transform(parts, lambda p, k: F.when(k < F.size(parts) - 1, inner(p)).otherwise(p)), ""))


def _where(t: Column, need: str | None, pattern: str, replacement: str) -> Column:
    if need is None:
        return F.regexp_replace(t, pattern, replacement)
    plain = re.fullmatch(r"[^\\\[\](){}.*+?|^$]+", need)  # looked for without a regular expression
    return _let(t, lambda s: F.when(F.contains(s, F.lit(need)) if plain else s.rlike(need), F.regexp_replace(s, pattern, replacement)).otherwise(s))


ENDS = (
    rf"{MARK}(?<!{MARK}{MARK}){MARK}*+(?:{CLOSE}++(?!{GOES_ON})"
    rf"|(?!{CLOSE})(?![,;:،、，；：؛/@_\\&=%#~]|[-–]\p{{L}})"
    # after a full stop or an ellipsis the sentence may run on
    rf"(?:(?<=[!?\x{{e0f0}}\x{{e0f1}}。！？｡؟।॥۔‼⁇⁈⁉։።។။།])(?!(?<=[?\x{{e0f0}}\x{{e0f1}}])[\p{{Ll}}\p{{N}}])|(?<=[.…])(?!{GAP}*+\p{{Ll}}(?!\p{{Lu}}))(?!(?<=\.)[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])))"
)
THAI = "[ก-๎]"
THAI_GAP = rf"(?<={THAI}[”»\"')]?){GAP}+(?=[“«\"'(]?{THAI})"


def pieces(text: Column) -> Column:
    """The masked text cut at every boundary; together the pieces are as long as the text."""
    t = F.regexp_replace(masked(text), ENDS, "$0" + CUT)
    t = _let(t, lambda s: F.when(s.rlike(THAI), F.regexp_replace(s, THAI_GAP, "$0" + CUT)).otherwise(s))
    return F.split(F.regexp_replace(t, r"[\r\n\x0b\x0c\x{2028}\x{2029}]++", "$0" + CUT), CUT)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


SLICE = 256


def restored(piece: Column) -> Column:
    marks = {**PLACE, **GREEK}
    return F.translate(piece, "".join(marks.values()), "".join(marks))


def spans(text: Column, size: Callable[[Column], Column] = F.length, with_text: bool = True) -> Column:
    """array<struct<start_pos, end_pos[, unit]>>: places counted by ``size`` of the text before, code points or bytes, and the unit with its marks restored."""
    units_type = f"array<struct<start_pos:int,end_pos:int{',unit:string' if with_text else ''}>>"

    def within(part: Column, start: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            body = F.ltrim(p, F.lit(BLANKS))
            lead = size(p) - size(body)
            unit = F.rtrim(body, F.lit(BLANKS))
            one = F.array(F.struct((acc["pos"] + lead).cast("int").alias("start_pos"), (acc["pos"] + lead + size(unit)).cast("int").alias("end_pos"), *([unit.alias("unit")] if with_text else [])))
            return F.struct((acc["pos"] + size(p)).cast("int").alias("pos"), F.when(F.length(unit) > 0, F.concat(acc["units"], one)).otherwise(acc["units"]).cast(units_type).alias("units"))

        return F.aggregate(part, F.struct(start.cast("int").alias("pos"), F.array().cast(units_type).alias("units")), add, lambda acc: acc["units"])

    def sliced(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SLICE).cast("int")), lambda k: F.slice(all_, k * SLICE + 1, F.lit(SLICE)))

        def add(acc: Column, part: Column) -> Column:
            whole = F.aggregate(part, F.lit(0), lambda n, p: n + size(p))
            return F.struct((acc["pos"] + whole).cast("int").alias("pos"), F.concat(acc["units"], F.array(within(part, acc["pos"]))).cast(f"array<{units_type}>").alias("units"))

        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{units_type}>").alias("units")), add, lambda acc: acc["units"]))

    # placeholders are as many code points as their marks, but not as many bytes
    return _let(pieces(text) if size is F.length and not with_text else F.transform(pieces(text), restored), sliced)


CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
GARBLED = "[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™]"


def meant(text: Column) -> Column:
    """The text that was meant, where UTF-8 was read as Windows-1252; else null."""

    def decoded(x: Column) -> Column:
        s = F.encode(x, "ISO-8859-1").cast("string")
        return F.when(x.rlike(r"\A[\x{0}-\x{ff}]*+\z"), _let(s, lambda y: F.when(F.is_valid_utf8(y), y)))

    return F.when(text.rlike(GARBLED), _let(F.translate(text, "".join(CP1252), "".join(CP1252.values())), decoded))


def _one_byte(encoding: str) -> str:
    return "".join(bytes([b]).decode(encoding, "replace") for b in range(0x80, 0x100))


def recased(text: Column) -> Column:
    """Windows-1251 that was read as KOI8-R (words of a small letter and capitals) as it was meant; of the same length."""
    pairs = [(a, b) for a, b in zip(_one_byte("koi8-r"), _one_byte("cp1251")) if "�" not in (a, b)]
    return F.when(text.rlike(r"(?s)(?<!\p{L})[а-яё][А-Я]{3}.*?(?<!\p{L})[а-яё][А-Я]{3}"), F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))).otherwise(text)


def _units(documents: DataFrame, text: str, keep: tuple[str, ...], with_text: bool) -> DataFrame:
    """(keep.., start_pos, end_pos[, unit])"""
    whole = documents.select(*keep, F.col(text).alias("t")).where("t is not null and t <> ''").select(*keep, "t", meant(F.col("t")).alias("m"))
    # every byte of a garbled text's meaning is one of its code points
    return whole.select(*keep, F.inline(F.when(F.col("m").isNull(), spans(recased(F.col("t")), F.length, with_text)).otherwise(spans(F.col("m"), F.octet_length, with_text))))


def sentence_units(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep.., start_pos, end_pos): one row for each unit."""
    return _units(documents, text, keep, False).select(*keep, "start_pos", "end_pos")


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, sentence) with the restored text; that of a garbled text is the one that was meant."""
    return _units(documents, "text", ("doc_id",), True).select("doc_id", "start_pos", "end_pos", F.col("unit").alias("sentence"))
