"""Template residue, filler, error pages and script notices among subtitle texts.

Labelled exemplars of residue stand in an inverted index of their rarest terms. Every text is scanned once for these terms; around each, the window of
the exemplar's length is compared with the exemplar by TF-IDF containment (the share of the exemplar's weight that the window holds, terms weighted by
their rarity in this corpus), and texts with a window of high containment are named: THRESHOLD for exemplars of five terms and more, more for shorter ones, which have little to lose
(see least_share). Frames are exemplars with slots between fixed terms; what a slot may hold is part of the label. Words are compared by skeletons (see cues), so that letter
case, wrapping, cue breaks, accents and misread characters do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmerframe.llm import cues

# Labelled exemplars. "#" is any number, "%name%" a name between marks; "**" a slot of any words up to 40, "*" of up to 6, "@" of one to five with a FIELDS word, "~" of four
# words, after or before, of which two are rare in the corpus. Brackets of template languages are terms of their own; "todo:" and "fixme:" count at the start of a cue, of a sentence, or capitalised of a line.
FRAMES = ["{{ ** }}", "{% ** %}", "{$ ** }", "${ ** }", "#{ ** }", "<% ** %>", "<< * >>", "@@ * @@", "&& * &&", "__ * __", "[[ ** ]]", "< insert * >", "[ your @ ]", "[ insert @ ]", "[ enter @ ]", "[ add @ ]", "[ type @ ]", "< your @ >", "lorem ~"]
PLACEHOLDERS = ["%name%", "[ sample cue # ]", "todo:", "fixme:", "line # text", "caption # goes here", "subtitle # goes here", "untranslated line # fill in later", "dummy line #", "placeholder line", "placeholder text", "type your caption here", "replace this text", "sample subtitle text replace before release", "hier steht später der untertitel", "hier kommt der untertitel", "hier text einfügen", "platzhalter text", "texte provisoire à remplacer", "texte à remplacer", "insérer le texte ici", "texto de ejemplo sustituir", "texto provisional sustituir", "insertar texto aquí", "testo di esempio da sostituire", "inserire testo qui", "insira o texto aqui", "tekst tijdelijk vervangen", "wstaw tekst tutaj", "вставьте текст здесь", "ここにテキストを入力", "ここに字幕を入力", "在此输入文本", "여기에 텍스트를 입력"]
FIELDS = ["name", "names", "user", "username", "speaker", "translator", "text", "title", "caption", "subtitle", "subtitles", "line", "date", "time", "season", "episode", "scene", "show", "label", "body", "id", "number", "email", "address", "city", "company", "language", "lang", "link", "url", "logo", "image", "dialogue", "description", "message", "translation", "credit", "credits", "password"]
FILLERS = ["lorem ipsum", "lorem ipsum dolor sit amet consectetur adipiscing elit", "norem ilsum kalor dit anet consetur vadip", "blindtext blindtext", "text text text text", "texte texte texte texte", "texto texto texto texto", "test test # test", "test test test test", "xxx xxx", "asdf asdf", "jkl jkl jkl", "abc abc abc", "foo foo foo", "foo bar baz", "aaa aaa aaa", "tbd tbd tbd"]
ERRORS = ["# not found nginx", "# not found apache", "# forbidden nginx", "# service unavailable", "# bad gateway", "# gateway timeout", "# internal server error", "page not found the page you requested may have moved", "http error # the service is temporarily unavailable", "error # the subtitle file could not be loaded", "internal server error reference #", "bad gateway upstream host did not answer #", "access denied you don't have permission to view this resource", "oops something went wrong on our end", "your session has expired please log in again to download", "you have exceeded your daily download limit try again tomorrow", "too many requests please slow down and try again in # seconds", "this file is no longer available and has been removed by the uploader", "verify that you are human to continue", "warning mysql fetch expects parameter #", "traceback most recent call last keyerror cue #", "traceback most recent call last", "you must log in to view this page", "please complete the captcha to continue", "seite nicht gefunden fehler #", "diese seite wurde nicht gefunden", "seite wurde nicht gefunden", "die angeforderte seite wurde nicht gefunden", "zugriff verweigert fehler #", "erreur # la page demandée est introuvable", "accès refusé erreur #", "error # página no encontrada", "la página solicitada no existe", "acceso denegado error #", "errore # pagina non trovata", "página não encontrada erro #", "pagina niet gevonden fout #", "strona nie została znaleziona błąd #", "страница не найдена ошибка #", "ページが見つかりません", "找不到页面", "페이지를 찾을 수 없습니다"]
SCRIPTS = ["javascript is required turn it on and reload", "scripting is off in this browser", "this app works best with scripts enabled yours are blocked", "you need to allow scripts in your browser to load the subtitles", "please enable javascript to view this page", "veuillez activer javascript pour continuer", "bitte aktivieren sie javascript um die untertitel zu sehen", "bitte schalten sie javascript ein", "active javascript en su navegador para continuar", "habilite javascript en su navegador para continuar", "abilita javascript per continuare", "ative o javascript no seu navegador para continuar", "schakel javascript in om verder te gaan", "włącz javascript aby kontynuować", "включите javascript чтобы продолжить", "javascriptを有効にしてください", "请启用javascript", "javascript를 활성화하십시오", "your browser does not support javascript"]
LEADS, THINGS = ["sorry the", "we're sorry this", "error the", "notice requested"], ["page", "file", "subtitle file", "caption track", "download link", "resource", "episode list"]
TROUBLES = ["could not be found", "is temporarily unavailable", "has been moved or deleted", "failed to load", "timed out", "is not accessible in your region"]
ASKERS, SWITCHES, SWITCHED = ["please", "you must", "to go on", "your browser asks you to", "you need to"], ["enable", "activate", "allow", "turn on"], ["javascript", "java script", "js", "scripts", "scripting"]
PURPOSES = ["to continue", "and reload this page", "in your browser settings", "to see the captions", "to view this page", "to load the subtitles"]
THRESHOLD, COMMON = 0.72, 0.01

CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
TOKEN = re.compile(rf"\{{\{{|\}}\}}|\{{%|%\}}|[$#]\{{|\{{\$|<%|%>|<<|>>|@@|&&|(?<![^\W_])__|__(?![^\W_])|(?<=\x02)(?i:(?:todo|fixme)\s*:)|%[^\W\d_][\w.-]*%|\$[^\W\d_][\w.-]*\$|(?<![{{$#])\{{[^\W\d_][\w.-]+\}}(?!\}})|[\[\]<>}}]|[{CJK}]|[^\W_{CJK}]+(?:['’][^\W_{CJK}]+)*")
NAMED = re.compile(r"[%$].+[%$]$|\{[^{}%$]+\}$")
TASK = re.compile(r"(?:\A|(?<=[\x02.!?…>}\])»*\"-]))\s*(?=(?i:todo|fixme)\s*:)|[\r\n]\s*(?=(?:TODO|ToDo|Todo|FIXME|Fixme)\s*:)")


def exemplars() -> list[str]:
    troubles = (" ".join(x) for x in product(LEADS, THINGS, TROUBLES))
    notices = (" ".join(x) for x in product(ASKERS, SWITCHES, SWITCHED, PURPOSES))
    asked = [x for f in FIELDS for x in (*(f"{verb} {f} here" for verb in ("insert", "enter", "add", "type")), f"your {f} goes here", f"insert {f} here")]
    return [*FRAMES, *PLACEHOLDERS, *FILLERS, *ERRORS, *SCRIPTS, *troubles, *notices, *asked]


# Rows of common keyboards, and letters that no interjection repeats.
ROWS, MUTE = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm"], "xyqjkbp"
KEYS = {cues.skeleton(row[i : i + n]) for row in ROWS for n in range(4, len(row) + 1) for i in range(len(row) - n + 1)}
SAME = {cues.skeleton(c * n) for c in MUTE for n in range(3, 17)}


def term(token: str) -> str:
    """The term of a token: '#' for a number, the marks of template languages as they are, '%keys%' for four and more keys in a row, '%same%' for one letter again and again, else a word's skeleton."""
    if not token[0].isalnum():
        return "%name%" if NAMED.match(token) else token
    if token[-1] == ":":
        return token[:-1].strip().lower() + ":"
    if token[0].isdigit() and len(token) <= 5 and not token.isalpha() and sum(c.isdigit() or c in "OolI" for c in token) == len(token):
        return "#"
    bones = cues.skeleton(token)
    return "%keys%" if bones in KEYS else "%same%" if bones in SAME else bones


class Terms(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[token] = made = term(token)
        return made


def tokens(text: str) -> list[str]:
    plain = cues.FORMAT.sub(" ", cues.TIME.sub("\x02", cues.INVISIBLE.sub("", cues.repair(text))))
    plain = TASK.sub("\x02", plain) if ":" in plain else plain
    return TOKEN.findall(plain)


SLOTS = {"**": 40, "*": 6, "@": 5, "~": 3}


def parsed(exemplar: str) -> tuple[str, ...]:
    """Terms of an exemplar; slots as they are written."""
    found = re.findall(r"\*\*|\*|(?<=\s)@(?=\s)|~|#(?!\{)|%name%|(?:todo|fixme):|" + TOKEN.pattern, exemplar)
    return tuple(t if t in SLOTS or t in ("#", "%name%") else term(t) for t in found)


def vocabulary(labelled: list[str]) -> set[str]:
    return {t for e in labelled for t in parsed(e)} - set(SLOTS)


def least_share(terms: int, threshold: float) -> float:
    """The containment asked of an exemplar of so many terms: up to three all of its weight, of four all but a cheap word."""
    return 0.97 if terms <= 3 else max(0.9, threshold) if terms == 4 else threshold


class Index:
    """Exemplars by their rarest terms, frames by their first one, with the weights that this corpus gives to terms. common: the terms that stand in many of its texts."""

    def __init__(self, labelled: list[str], counts: dict[str, int], texts: int, threshold: float = THRESHOLD, anchors: int = 3, common: frozenset[str] = frozenset()):
        self.weight = {t: 1 + math.log((texts + 1) / (counts.get(t, 0) + 1)) for t in vocabulary(labelled)}
        self.common, self.fields = common, {term(f) for f in FIELDS}
        self.exemplars, self.by_term, self.frames = [], {}, {}
        for e in dict.fromkeys(map(parsed, labelled)):
            slots = [i for i, t in enumerate(e) if t in SLOTS]
            if slots:
                self.frames.setdefault(e[0], []).append((e[: slots[0]], e[slots[0]], e[slots[0] + 1 :]))
                continue
            bag = Counter(e)
            rare = sorted(bag, key=lambda t: (-self.weight[t], t))[:anchors]
            number = len(self.exemplars)
            # a long exemplar may have up to two words between its own, one of four terms one, a shorter one none
            whole = sum(self.weight[t] * n for t, n in bag.items())
            self.exemplars.append((bag, whole * least_share(len(e), threshold), len(e), max(0, min(2, len(e) - 3))))
            for t in rare:
                self.by_term.setdefault(t, []).append((number, [i for i, x in enumerate(e) if x == t]))

    def matches(self, terms: list[str]) -> bool:
        """Whether some window of the terms holds enough of an exemplar's weight, or a frame stands among them."""
        for place, t in enumerate(terms):
            for number, spots in self.by_term.get(t, ()):
                bag, enough, size, slack = self.exemplars[number]
                for spot in spots:
                    left = spot and slack
                    window = Counter(terms[max(0, place - spot - left) : place - spot + size + slack])
                    if sum(self.weight[x] * min(n, window[x]) for x, n in bag.items() if x in window) >= enough - 1e-9:
                        return True
            for before, slot, after in self.frames.get(t, ()):
                if tuple(terms[place : place + len(before)]) == before and self._fills(terms, place + len(before), slot, after):
                    return True
        return False

    def _fills(self, terms: list[str], start: int, slot: str, after: tuple[str, ...]) -> bool:
        if slot == "~":
            return any(sum(t not in self.common and t[:1].isalnum() for t in around) >= 2 for around in (terms[start : start + 4], terms[max(0, start - 5) : max(0, start - 1)]))
        for end in range(start, min(len(terms) - len(after), start + SLOTS[slot]) + 1):
            if tuple(terms[end : end + len(after)]) == after:
                return slot != "@" or not self.fields.isdisjoint(terms[start:end])
        return False


def term_counts(df: DataFrame, labelled: list[str], text_col: str = "text", common: float = COMMON) -> tuple[dict[str, int], int, frozenset[str]]:
    """In how many texts each term of the exemplars stands, over all texts; the number of texts; and the terms that stand in more than the share `common` of them.

    What reaches the driver is bounded: by the exemplars, and by the mean number of different terms of a text through `common`.
    """
    wanted = vocabulary(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = Terms(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update({terms[t] for t in set(tokens(text))})
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})
                counts = Counter()
        yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})

    texts = df.filter(F.col(text_col) != "").select(F.col(text_col).cast("string").alias("__text"))
    total = texts.count()
    every = texts.mapInArrow(run, "term string, n long").filter(F.col("term") != "").groupBy("term").agg(F.sum("n").alias("n"))
    rows = every.filter(F.col("term").isin(sorted(wanted)) | (F.col("n") > common * total)).collect()
    counts = {r.term: r.n for r in rows}
    return {t: n for t, n in counts.items() if t in wanted}, total, frozenset(t for t, n in counts.items() if n > common * total)


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col), without repeats: texts of which a passage window holds at least threshold of the TF-IDF weight of an exemplar (short ones: see least_share) or a frame.

    labelled: exemplars in the notation of FRAMES; those of this module by default. Two scans of the texts, no shuffle of texts: one counts
    terms over the whole corpus, one compares windows. Null and empty texts never match; repeated ids give one row; an empty
    table gives an empty result; other columns are ignored; very long texts are scanned whole.
    """
    labelled = exemplars() if labelled is None else labelled
    counts, texts, common = term_counts(df, labelled, text_col)
    index = df.sparkSession.sparkContext.broadcast(Index(labelled, counts, texts, threshold, common=common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = Terms(), index.value
        for batch in batches:
            hit = [held.matches([t for t in map(terms.__getitem__, tokens(text)) if t]) for text in batch.column(1).to_pylist()]
            yield batch.select([0]).filter(pa.array(hit, pa.bool_()))

    kind = df.schema[id_col].dataType.simpleString()
    return df.filter(F.col(text_col) != "").select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}").distinct()


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df, all columns, whose text is no residue; rows with a null id stay."""
    return df.join(find_residue(df, id_col, text_col, **how), id_col, "left_anti")
