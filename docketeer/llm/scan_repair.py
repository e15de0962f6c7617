"""Problem 1: noise in text from scanned pages.

Every page's lines are told apart (running headers, page numbers, running text, blanks) and words broken at line ends are put together.
Running headers are established by repetition: lines that return at the edges of a document's pages show boosted trees, fitted on
a bounded sample, what a header looks like here, so that those of documents of one page are found as well.
A vocabulary is counted over all pages. Words unknown to it are run as Levenshtein automata, with merges and splits of
two characters as single errors, against tries of the vocabulary, which yields all candidates within the distance. Which
errors the scanner makes is learned from the candidates themselves; candidates are ranked by that, by frequency and by
the neighbouring words. Then page furniture leaves and the text is set in paragraphs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, lookup_side, map_arrow

#: Most frequent clean words, known to every task; the rest is looked up by join.
COMMON_WORDS = 20_000
#: Words of one trie, and unknown words searched in it by one task.
TRIE_WORDS, ASKED_WORDS = 150_000, 20_000
#: Error pairs kept, at most; they are pairs of one or two characters.
MOST_ERRORS = 400
#: Scanned pages, whole documents chosen by hash, on which the trees for running headers are fitted.
SAMPLE_PAGES = 3_000

HYPHENS = "-¬‐­"
#: Fixed values.
_MONTHS = "january february march april may june july august september october november december".split()
_ROMAN = {r: i for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
_DIGITS = str.maketrans("OolI|S", "001115")
#: Symbols read in place of letters: a bar or an at sign that touches letters.
_SYMBOL = re.compile(r"[^\W\d_]\||\|[^\W\d_]|(?:^|[\s\"“(’'])@[^\W\d_]*(?=[\s.,;:!?”\")]|$)|[^\W\d_]@(?=[\s.,;:!?”\")]|$)")
_NO = r"([\dOolI|]{1,4})"
_PAGE_NO = re.compile(rf"([ivx]{{1,5}}|[IVX]{{1,5}})|[-–—] ?{_NO} ?[-–—]|\[ ?{_NO} ?\]|{_NO} ?/ ?[\dOolI|]{{1,4}}|\(?{_NO}\)?|[Pp]\. ?{_NO}|[Pp][aA@][gG9][ecECE] {_NO}(?: [oO0][fFtT] [\dOolI|]{{1,4}})?")
_WORD = re.compile(r"[^\W_](?:[\w@|~·]*[^\W_])?(?:['’][^\W\d_]+)?", re.S)
_ADDRESS_LIKE = re.compile(r"\S*[@/\\]\S*\.\S+|\S*\(at\)\S*|^[@/]\S+|\S+://\S+")


_NOT_LETTERS = re.compile(r"[\W\d_]+")
_TRAILING_NO = re.compile(r" {3,}[\dOolI|]{1,4}$")
_GAP = re.compile(r"\S {3,}(?=\S)")
_LABEL = re.compile(r"[^\W\d_]+: ")
#: An a at the beginning of a word, read as an at sign.
_LONE_AT = re.compile(r"[\"“(]*@[^\W\d_]*[.,;:”\")]*")


# --- lines ---------------------------------------------------------------------------------------------------


def page_number_of(line: str) -> int | None:
    line = line.strip()
    m = _PAGE_NO.fullmatch(line) if len(line) < 20 else None
    if not m:
        return None
    value = next(g for g in m.groups() if g)
    if m[1] and value.lower() in _ROMAN:
        return _ROMAN[value.lower()]
    value = value.translate(_DIGITS)
    return int(value) if value.isdigit() else None


def _bare(line: str) -> str:
    return _NOT_LETTERS.sub("", line.lower())


def _begins(line: str) -> str:
    """The first nine letters; as a rule they stand in the first forty characters."""
    bare = _bare(line[:40])
    return (bare if len(bare) > 9 else _bare(line))[:9]


def _digits(text: str) -> int:
    return sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))


def _close(a: str, b: str) -> bool:
    return len(a) > 3 and sum(x == y for x, y in zip(a, b, strict=False)) >= len(a) - 2


def line_form(lines: list[str], filled: list[int], at: int) -> tuple | None:
    """What a line looks like and where it stands, in small numbers; ``filled`` are the lines that aren't blank. None for lines that no header looks like."""
    i = filled[at]
    raw = lines[i]
    text = raw.strip()
    if not 5 <= len(text) <= 99 or text[0].islower():
        return None
    body = _TRAILING_NO.sub("", raw.rstrip()).strip() if "   " in raw else text
    words = body.split()
    if not words:
        return None
    after = lines[filled[at + 1]].strip() if at + 1 < len(filled) else ""
    third = lines[filled[at + 2]].strip() if at + 2 < len(filled) else ""
    digits = _digits(body)
    capitals = sum(w[0].isupper() or w[0].isdigit() for w in words)
    follows = 0 if not after else 1 if after[0].islower() else 2 if _close(_begins(body), _begins(after)) else 3 if after[0].isalnum() else 4
    goes_on = (after + " " + third)[:90]
    return (
        min(at, 3), min(len(filled) - 1 - at, 3), min(len(body) // 4, 15), min(len(words), 9), 5 * capitals // len(words), min(digits // 2, 6), int(body != text),
        1 if body[-1] in ".!?”" else 2 if body[-1] in ",;:—-" else 0, min(len(_GAP.findall(body)), 3) if "   " in body else 0, int(" v. " in body or " V. " in body), int("|" in body), int(" - " in body or " – " in body), int("/" in body),
        int(_LABEL.match(body) is not None), follows, int(i + 1 < len(lines) and not lines[i + 1].strip()), int(i > 0 and not lines[i - 1].strip()), int(body.upper() == body), int("—" in body), int("—" in goes_on),
        int("@" in body or "<" in body), min(len(after) // 12, 6), min(_digits(goes_on) // 2, 6),
    )


class Headers:
    """Trees that tell running headers by their form; without trees nothing is one."""

    def __init__(self, trees=None):
        self.trees = trees

    def among(self, lines: list[str], filled: list[int]) -> set[int]:
        if self.trees is None:
            return set()
        out = set()
        for at, i in enumerate(filled):
            form = line_form(lines, filled, at)
            if form is not None and self.trees.accepts(form):
                out.add(i)
        return out


def learn_headers(pages: DataFrame, sample: int = SAMPLE_PAGES, least: int = 10) -> Headers:
    """Fit on the pages of about ``sample`` scanned pages' documents that have three such pages or more: a line at the edge of a page that stands on
    another page of its document too, but for digits and case, is a header; all other lines are taken for none. Some headers are read so badly that
    they don't seem to return, so a line counts from half of what the others reach on. Fewer than ``least`` such lines teach nothing."""
    from docketeer.llm.boosting import fit

    scanned = pages.where("ocr_used and ocr_text is not null and document_id is not null").select("id", "document_id", "ocr_text").distinct()
    several = scanned.groupBy("document_id").agg(F.count("*").alias("k")).where("k > 2")
    n = several.agg(F.sum("k")).first()[0] or 0
    picked = several.where(F.pmod(F.xxhash64("document_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("document_id")
    by_doc: dict[str, list[str]] = defaultdict(list)
    for r in scanned.join(lookup_side(cut(picked)), "document_id").select("document_id", "id", "ocr_text").orderBy("document_id", "id").collect():  # the sample
        by_doc[r[0]].append(r[2])
    rows, labels = [], []
    for texts in by_doc.values():
        split = [_split(t) for t in texts]
        places = [[i for i, line in enumerate(lines) if line.strip()] for lines in split]
        edges = [{_bare(lines[i]) for i in {*filled[:2], *filled[-2:]}} for lines, filled in zip(split, places, strict=True)]
        seen = Counter(k for e in edges for k in e if len(k) > 4)
        for lines, filled in zip(split, places, strict=True):
            for at, i in enumerate(filled):
                form = line_form(lines, filled, at)
                if form is not None:
                    rows.append(form)
                    labels.append(int(seen[_bare(lines[i])] > 1))
    if sum(labels) < least:
        return Headers()
    trees = fit(rows, labels, rounds=40, depth=4)
    trees.threshold /= 2
    return Headers(trees)


def line_kinds(lines: list[str], page_number: int | None, headers: Headers = Headers()) -> list[str]:
    """blank, page_number, header or text for each line."""
    kinds = []
    running = headers.among(lines, [i for i, line in enumerate(lines) if line.strip()])
    for i, line in enumerate(lines):
        if not line.strip():
            kinds.append("blank")
        elif (n := page_number_of(line)) is not None and (page_number is None or n == page_number):
            kinds.append("page_number")
        else:
            kinds.append("header" if i in running else "text")
    return kinds


def broken_words(lines: list[str], kinds: list[str]) -> dict[int, int]:
    """Lines that end inside a word -> the line of running text in which it goes on."""
    texts = [i for i, k in enumerate(kinds) if k == "text"]
    out = {}
    for i, j in zip(texts, texts[1:], strict=False):
        a, b = lines[i].rstrip(), lines[j].lstrip(" ·~")
        if len(a) > 2 and a[-1] in HYPHENS and (a[-2].isalpha() or a[-2] in "@|0159") and b[:1] and (b[0].isalpha() or b[0] in "@|0159"):
            out[i] = j
    return out


# --- words ---------------------------------------------------------------------------------------------------


_CHUNKS: dict[str, tuple[str, ...]] = {}
_EDGES = ".,;:!?\"“”()[]"


def chunk_words(chunk: str) -> tuple[str, ...]:
    """The words of a run of characters without blanks; numbers alone are none. Remembered, as most runs return."""
    found = _CHUNKS.get(chunk)
    if found is None:
        if len(_CHUNKS) > 300_000:
            _CHUNKS.clear()
        bare = chunk.strip(_EDGES)
        if bare.isalpha():
            found = (bare,)
        elif _LONE_AT.fullmatch(chunk):
            found = ("@" + chunk.strip("\"“(.,;:@"),)
        elif _ADDRESS_LIKE.search(chunk):
            found = tuple(m[0] for m in re.finditer(r"[^\W_]+", chunk) if not m[0].isdigit())
        else:
            found = tuple(m[0] for m in _WORD.finditer(chunk) if not m[0].isdigit())
        _CHUNKS[chunk] = found
    return found


def words_in(lines: list[str], kinds: list[str], broken: dict[int, int]) -> Iterator[tuple[int, int, int, str]]:
    """(line, line of the rest, letters before the break, word as written). Whole words have the same line twice."""
    head: tuple[int, str] | None = None
    for i, line in enumerate(lines):
        if kinds[i] != "text":
            continue
        chunks = line.split()
        for k, chunk in enumerate(chunks):
            first, last = k == 0, k == len(chunks) - 1
            if last and i in broken:
                before = chunk.rstrip(HYPHENS)
                found = list(_WORD.finditer(before))
                tail = found[-1] if found and found[-1].end() == len(before) else None
                for m in found[: -1 if tail else None]:
                    yield i, i, len(m[0]), m[0]
                head = (i, tail[0]) if tail else None
                continue
            if first and head and not _ADDRESS_LIKE.search(chunk):
                found = list(_WORD.finditer(chunk))
                if found:
                    yield head[0], i, len(head[1]), head[1] + found[0][0]
                    head = None
                    for m in found[1:]:
                        yield i, i, len(m[0]), m[0]
                    continue
            head = None if first else head
            for word in chunk_words(chunk):
                yield i, i, len(word), word


def slipped_number(word: str) -> bool:
    """Digits with letters among them that look like digits."""
    return bool(re.search(r"\d", word)) and re.fullmatch(r"(?:[\dOolI|]|S(?=\d))+|\d{3}S", word) is not None and not word.isdigit()


# --- automaton and trie ----------------------------------------------------------------------------------------


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def _follow(node: dict, rest: str) -> str | None:
    for c in rest:
        node = node.get(c)
        if node is None:
            return None
    return node.get("")


def within_one(root: dict, w: str) -> Iterator[tuple[str, str, str, int]]:
    """(candidate, its characters, the characters read instead, place): all words of the trie at distance one from ``w``.

    The automaton has one exact path; at each of its states every error leads to an exact tail, which is followed where its first character
    (the mark of a word's end, where nothing is left) goes on.
    """
    node, n = root, len(w)
    for i in range(n + 1):
        same, rest, shorter = w[i:], w[i + 1 :], w[i + 2 :]
        here, follows, later = same[:1], rest[:1], shorter[:1]
        if i < n and follows in node and (v := _follow(node, rest)):
            yield v, "", here, i
        for c, child in node.items():
            if not c:
                continue
            if here in child and (v := _follow(child, same)):
                yield v, c, "", i
            if i < n and c != here:
                if follows in child and (v := _follow(child, rest)):
                    yield v, c, here, i
                for d, grand in child.items():
                    if d and follows in grand and (v := _follow(grand, rest)):
                        yield v, c + d, here, i
            if i + 1 < n and later in child and (v := _follow(child, shorter)):
                yield v, c, w[i : i + 2], i
        if i < n:
            node = node.get(here)
            if node is None:
                return


def within_two(root: dict, w: str, errors: dict[str, list[str]]) -> Iterator[tuple[str, int]]:
    """(candidate, place of its last error): words reached by up to two errors of the known kinds, read -> meant."""
    stack = [(root, 0, 0, -1)]
    n = len(w)
    while stack:
        node, i, e, at = stack.pop()
        if i == n:
            if "" in node and e:
                yield node[""], at
            continue
        if (child := node.get(w[i])) is not None:
            stack.append((child, i + 1, e, at))
        if e < 2:
            for size in (1, 2):
                for meant in errors.get(w[i : i + size], ()) if i + size <= n else ():
                    child = node
                    for c in meant:
                        child = child.get(c)
                        if child is None:
                            break
                    if child is not None:
                        stack.append((child, i + size, e + 1, i))


# --- plans -----------------------------------------------------------------------------------------------------


def _split(text: str) -> list[str]:
    return text.split("\n")


def word_counts(pages: DataFrame, headers: Headers) -> DataFrame:
    """(word in lower case, clean, scanned): in how many places on clean and on scanned pages. Counted within each task first."""
    rows = pages.select(F.when(F.col("ocr_used"), F.col("ocr_text")).otherwise(F.col("final_text")).alias("text"), F.coalesce("ocr_used", F.lit(False)).alias("scan"), "page_number").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter = Counter()
        scanned: Counter = Counter()
        for batch in batches:
            for text, scan, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if scan:
                    lines = _split(text)
                    kinds = line_kinds(lines, number, headers)
                    scanned.update(w.lower() for _, _, _, w in words_in(lines, kinds, broken_words(lines, kinds)))
                else:
                    runs.update(text.lower().split())
            if len(runs) + len(scanned) > 500_000:
                yield out(words_of_runs(runs), scanned)
                runs, scanned = Counter(), Counter()
        yield out(words_of_runs(runs), scanned)

    def words_of_runs(runs: Counter) -> Counter:
        clean: Counter = Counter()
        for chunk, n in runs.items():
            for w in _WORD.findall(chunk):
                clean[w] += n
        return clean

    def out(clean: Counter, scanned: Counter) -> pa.RecordBatch:
        words = list(clean.keys() | scanned.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([clean[w] for w in words], pa.int64()), pa.array([scanned[w] for w in words], pa.int64())], names=["word", "clean", "scanned"])

    return map_arrow(rows, run, "word string, clean bigint, scanned bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


def _trie_groups(vocabulary: DataFrame, asked: DataFrame, reach: int, run, schema: str) -> DataFrame:
    """Meet every asked word with every vocabulary word of a length within ``reach``, in blocks of bounded size on both sides."""
    n_words, n_asked = vocabulary.count(), asked.count()
    # a quarter of the words may have one length
    tries, parts = max(1, math.ceil(n_words / 4 / TRIE_WORDS)), max(1, math.ceil(n_asked / 4 / ASKED_WORDS))
    lengths = F.array(*[F.length("word") + k for k in range(-reach, reach + 1)])
    words = vocabulary.select("word", "n", F.length("word").alias("size"), F.pmod(F.xxhash64("word"), F.lit(tries)).cast("int").alias("trie"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    ask = asked.select("word", "n", F.explode(lengths).alias("size")).withColumn("trie", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    ask = ask.withColumn("part", F.pmod(F.xxhash64("word", F.lit("part")), F.lit(parts)).cast("int"))
    keys = ["size", "trie", "part"]
    # the work is in the tries rather than in the bytes: a fixed number of partitions, which AQE doesn't join into one
    n = min(4096, 24 * tries * parts)
    return words.repartition(n, *keys).groupBy(*keys).cogroup(ask.repartition(n, *keys).groupBy(*keys)).applyInPandas(run, schema)


def corrections(counts: DataFrame, least: int = 2, ratio: float = 2.0, short_ratio: float = 50.0) -> DataFrame:
    """(word, meant, place): misread words, what they most likely are, and where the error is; several rows where candidates are on a par.

    A word on clean pages is no misreading. Candidates need ``least`` places and ``ratio`` times the word's own. An error pair
    counts as the scanner's when it explains enough unknown words; a word within distance one by no such pair is left alone.
    """
    from docketeer.runtime import ship

    spark = counts.sparkSession
    ship(spark)
    letters = F.col("word").rlike(r"^[\p{L}\p{M}'’]+$")
    vocabulary = cut(counts.where(letters & (F.length("word") > 1) & ((F.col("clean") > 0) | (F.col("scanned") > 1)) & (F.col("clean") + F.col("scanned") >= least)).select("word", (F.col("clean") + F.col("scanned")).alias("n")))
    asked = cut(counts.where((F.col("clean") == 0) & (F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).select("word", F.col("scanned").alias("n")))

    def one(words: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(words) and len(ask):
            n_of, trie = dict(zip(words["word"], words["n"], strict=True)), build_trie(list(words["word"]))
            for w, n in zip(ask["word"], ask["n"], strict=True):
                for v, meant, read, at in within_one(trie, w):
                    if n_of[v] >= ratio * n:
                        rows.append((w, n, v, n_of[v], meant, read, at))
        return pd.DataFrame(rows, columns=["word", "n", "meant", "n_meant", "was", "read", "place"])

    # a merge makes the read word one shorter, a split one longer
    near = cut(_trie_groups(vocabulary, asked, 1, one, "word string, n bigint, meant string, n_meant bigint, was string, read string, place int"))
    # a word of two letters is near too many others to teach anything
    best = near.where(F.length("word") > 2).groupBy("word").agg(F.max_by(F.struct("was", "read"), "n_meant").alias("e"), F.max("n").alias("n"))
    pairs = best.groupBy("e.was", "e.read").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    total = best.agg(F.sum("n")).first()[0] or 0
    # an error needs letters on both sides: dropped or added single characters are typists' slips, no scanner's
    pairs = pairs.where("was <> '' and read <> ''").where((F.col("words") >= 3) & (F.col("n") >= max(4.0, 0.002 * total))).orderBy(F.desc("n"), "was", "read").limit(MOST_ERRORS)
    known = {(r["was"], r["read"]) for r in pairs.collect()}
    known |= {(b, a) for a, b in known if len(a) + len(b) == 3}
    if not known:
        return spark.createDataFrame([], "word string, meant string, n_meant bigint, place int")
    table = spark.createDataFrame(sorted(known), "was string, read string")
    # nor is it corrected but to a far more frequent word of its length
    plain = (F.length("word") > 2) | ((F.length("meant") == 2) & (F.col("n_meant") >= short_ratio * F.col("n")))
    first = near.where(plain).join(F.broadcast(table), ["was", "read"]).select("word", "meant", "n_meant", "place")
    first = cut(first)
    by_read: dict[str, list[str]] = defaultdict(list)
    for was, read in sorted(known):
        by_read[read].append(was)

    def two(words: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(words) and len(ask):
            n_of, trie = dict(zip(words["word"], words["n"], strict=True)), build_trie(list(words["word"]))
            for w, n in zip(ask["word"], ask["n"], strict=True):
                rows += [(w, v, n_of[v], at) for v, at in set(within_two(trie, w, by_read)) if n_of[v] >= ratio * n]
        return pd.DataFrame(rows, columns=["word", "meant", "n_meant", "place"])

    rest = cut(asked.join(first.select("word").distinct(), "word", "left_anti").where(F.length("word") > 4))
    second = cut(_trie_groups(vocabulary, rest, 2, two, "word string, meant string, n_meant bigint, place int"))
    return first.unionByName(second).unionByName(_telltale(spark, asked, first, second, known))


def _telltale(spark, asked: DataFrame, first: DataFrame, second: DataFrame, known: set[tuple[str, str]]) -> DataFrame:
    """Unknown words without a candidate that have a character which elsewhere nearly always is an error: rare names, as a rule."""
    single = sorted((read, was) for was, read in known if len(read) == 1 and not read.isascii())
    if not single:
        return first.limit(0)
    table = spark.createDataFrame(single, "read string, was string").groupBy("read").agg(F.min("was").alias("was"))
    having = asked.join(F.broadcast(table), F.expr("contains(word, read)"))
    solved = first.select("word").unionByName(second.select("word")).distinct().withColumn("solved", F.lit(1))
    having = cut(having.join(solved, "word", "left"))
    sure = having.groupBy("read").agg(F.count("*").alias("all"), F.count("solved").alias("some")).where((F.col("some") >= 5) & (F.col("some") >= 0.7 * F.col("all"))).select("read")
    rest = having.where("solved is null").join(F.broadcast(sure), "read")
    return rest.select("word", F.expr("replace(word, read, was)").alias("meant"), F.col("n").alias("n_meant"), (F.expr("locate(read, word)") - 1).cast("int").alias("place"))


def scan_lines(pages: DataFrame, counts: DataFrame, fixes: DataFrame, headers: Headers) -> DataFrame:
    """(page_id, line_no, kind): hyphen, header, page_number and misread lines of scanned pages' ocr_text.

    pages: id, document_id, page_number, ocr_used, ocr_text, final_text. Null and empty texts and pages not scanned give no rows; repeated pages count once.
    """
    # both branches read it: written once
    lines = cut(_scan(pages, counts, headers))
    unclear = lines.where("word is not null")
    clear = lines.where("word is null").select("page_id", "line_no", "kind")
    places = fixes.groupBy("word").agg(F.max_by("place", "n_meant").alias("place"))
    hit = unclear.join(places, "word").select("page_id", F.when(F.col("place") < F.col("before"), F.col("line_no")).otherwise(F.col("line_to")).alias("line_no"), F.lit("misread").alias("kind"))
    return clear.unionByName(hit).distinct()


def _noise_characters(pages: DataFrame, ratio: float = 50.0, least: int = 10) -> set[str]:
    """Symbols that scanned pages have ``ratio`` times as often as clean ones: those that the scanner puts in."""
    rows = pages.select(F.coalesce("ocr_used", F.lit(False)).alias("scan"), F.when(F.col("ocr_used"), F.col("ocr_text")).otherwise(F.col("final_text")).alias("text")).where("text is not null")
    symbols = rows.select("scan", F.length("text").alias("n"), F.regexp_replace("text", r"[\p{L}\p{N}\p{M}\s]+", "").alias("s"))
    sizes = {r["scan"]: r["n"] for r in symbols.groupBy("scan").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        return set()
    each = symbols.select("scan", F.explode(F.split("s", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.sum(F.col("scan").cast("int")).alias("dirty"), F.sum((~F.col("scan")).cast("int")).alias("clean"))
    factor = sizes[False] / max(1, sizes[True])
    found = each.where((F.col("dirty") >= least) & (F.col("dirty") * factor >= ratio * (F.col("clean") + 0.5))).select("c").limit(100).collect()
    return {r["c"] for r in found} - set(HYPHENS) - set("–—")


def _common(counts: DataFrame) -> set[str]:
    """At most COMMON_WORDS words: those above a count that a histogram of the counts gives, so that no more than these go to the driver."""
    histogram = counts.where("clean > 0").groupBy(F.floor(F.log2(F.col("clean")) * 4).alias("bin")).agg(F.count("*").alias("words"), F.min("clean").alias("least")).collect()
    total, least = 0, None
    for r in sorted(histogram, key=lambda r: -r["bin"]):
        total += r["words"]
        if total > COMMON_WORDS:
            break
        least = r["least"]
    return {r["word"] for r in counts.where(F.col("clean") >= least).select("word").collect()} if least is not None else set()


def _scan(pages: DataFrame, counts: DataFrame, headers: Headers) -> DataFrame:
    """Lines with a clear kind, and unclear words: (page_id, line_no, line_to, before, word, kind)."""
    common = _common(counts)
    noise = _noise_characters(pages)
    inserted = re.compile("[" + re.escape("".join(sorted(noise))) + "]") if noise else None
    rows = pages.where("ocr_used and ocr_text is not null").select(F.col("id").alias("page_id"), "page_number", "ocr_text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, number, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = _split(text)
                kinds = line_kinds(lines, number, headers)
                broken = broken_words(lines, kinds)
                for i, kind in enumerate(kinds):
                    if kind in ("header", "page_number"):
                        out.append((page, i, i, 0, None, kind))
                    elif kind == "text" and ((inserted and inserted.search(lines[i])) or (("|" in lines[i] or "@" in lines[i]) and _SYMBOL.search(lines[i]))):
                        out.append((page, i, i, 0, None, "misread"))
                out += [(page, i, i, 0, None, "hyphen") for i in broken]
                for i, j, before, word in words_in(lines, kinds, broken):
                    if word in common:
                        continue
                    low = word.lower()
                    if low in common:
                        continue
                    if word[0] == "@" or slipped_number(word) or re.search(r"[^\W\d_][@|0159][^\W\d_]|[\ufb00-\ufb04]", word):
                        at = next((k for k, c in enumerate(word) if c in "@|0159" or c in "OolIS" and slipped_number(word)), 0)
                        out.append((page, i if at < before else j, i, 0, None, "misread"))
                        if slipped_number(word):
                            continue
                    out.append((page, i, j, before, low, "word"))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int32()) for c in cols[1:4]] + [pa.array(c, pa.string()) for c in cols[4:]], names=["page_id", "line_no", "line_to", "before", "word", "kind"])

    return map_arrow(rows, run, "page_id string, line_no int, line_to int, before int, word string, kind string")


def find_noise(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no, kind) of all scanned pages; ``names`` (name) adds known names to the vocabulary."""
    headers = learn_headers(pages)
    counts = cut(_with_names(word_counts(pages, headers), names))
    return scan_lines(pages, counts, cut(corrections(counts)), headers)


def _with_names(counts: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return counts
    known = names.where("name is not null").select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{M}'’]+)"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("clean"))
    return counts.unionByName(known.select("word", "clean", F.lit(0).cast("bigint").alias("scanned"))).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


def repair(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(page_id, text): scanned pages as continuous paragraphs of the original wording.

    Headers and page numbers leave, broken words are joined, misread words give way to the candidate that fits the neighbouring words
    best, inserted characters leave, lines are joined, blank lines and the end of a title part paragraphs. Null texts stay null.
    """
    headers = learn_headers(pages)
    counts = cut(_with_names(word_counts(pages, headers), names))
    fixes = cut(corrections(counts))
    noise = _noise_characters(pages)
    unclear = cut(_scan(pages, counts, headers).where("word is not null").select("page_id", "word").distinct())
    ranked = fixes.join(_context(pages, fixes, counts), ["word", "meant"], "left").groupBy("word").agg(F.max_by("meant", F.struct(F.coalesce("near", F.lit(0)), "n_meant", "meant")).alias("meant"))
    mine = unclear.join(ranked, "word").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("fixes"))
    rows = pages.where("ocr_used").select(F.col("id").alias("page_id"), "page_number", "ocr_text").distinct().join(mine, "page_id", "left")
    drop = str.maketrans(dict.fromkeys(noise, ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if text is None else reflow(text, number, dict(own or ()), drop, headers) for number, text, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "text"])

    return map_arrow(rows, run, "page_id string, text string")


def _context(pages: DataFrame, fixes: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, meant, near): how often a candidate stands on clean pages beside words that the misread word stands beside."""
    several = fixes.groupBy("word").agg(F.count_distinct("meant").alias("k")).where("k > 1").select("word")
    open_ = cut(fixes.join(several, "word", "left_semi").select("word", "meant").distinct())
    text = F.lower(F.when(F.col("ocr_used"), F.col("ocr_text")).otherwise(F.col("final_text")))
    tokens = pages.select(F.coalesce("ocr_used", F.lit(False)).alias("scan"), F.split(text, r"[^\p{L}\p{M}\p{N}@|']+").alias("t")).where("t is not null")
    couples = tokens.select("scan", F.explode(F.expr("transform(sequence(1, greatest(size(t) - 1, 1)), i -> struct(t[i - 1] as a, t[i] as b))")).alias("p")).select("scan", "p.a", "p.b").where("a <> '' and b <> ''")
    sides = couples.select("scan", F.col("b").alias("word"), F.concat(F.lit("<"), "a").alias("beside")).unionByName(couples.select("scan", F.col("a").alias("word"), F.concat(F.lit(">"), "b").alias("beside")))
    wanted = open_.select("word").unionByName(open_.select(F.col("meant").alias("word"))).distinct()
    sides = sides.join(lookup_side(wanted), "word", "left_semi")
    seen = sides.where("scan").select("word", "beside").distinct().join(open_, "word")
    clean = sides.where("not scan").groupBy(F.col("word").alias("meant"), "beside").agg(F.count("*").alias("n"))
    return seen.join(clean, ["meant", "beside"]).groupBy("word", "meant").agg(F.sum("n").alias("near"))


def _like(word: str, meant: str) -> str:
    """``meant`` in the case of ``word``."""
    if word.upper() == word and sum(c.isalpha() for c in word) > 1:
        return meant.upper()
    return meant[:1].upper() + meant[1:] if word[:1].isupper() or (word[:1].isdigit() and word[1:2].isupper()) else meant


def reflow(text: str, page_number: int | None, fixes: dict[str, str], drop: dict, headers: Headers) -> str:
    lines = _split(text)
    kinds = line_kinds(lines, page_number, headers)
    broken = broken_words(lines, kinds)

    def mend(chunk: str) -> str:
        if _ADDRESS_LIKE.search(chunk):
            return chunk
        if _LONE_AT.fullmatch(chunk):
            chunk = chunk.replace("@", "a")
        chunk = _WORD.sub(lambda m: _like(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0].translate(_DIGITS) if slipped_number(m[0]) else m[0], chunk)
        return chunk

    paragraphs: list[list[str]] = [[]]
    glued = ""
    for i, line in enumerate(lines):
        if kinds[i] == "blank":
            if not glued and paragraphs[-1]:
                paragraphs.append([])
            continue
        if kinds[i] != "text":
            continue
        words = line.translate(drop).split()
        if glued and words:
            words[0] = glued + words[0]
            glued = ""
        if i in broken and words:
            glued = words.pop().rstrip(HYPHENS)
        paragraphs[-1] += [mend(w) for w in words]
    if glued:
        paragraphs[-1].append(glued)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)
