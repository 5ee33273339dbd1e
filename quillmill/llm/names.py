"""Problem 2: link the entries of one project that name the same person, place or organisation.

Method: canonical rewritings. Every entry is parsed on both sides (source and target term) into given names,
initials, family name or the content words of a place or body (all of them, in any order), kind of organisation or
place, legal form, title, ordinal and epithet. All its rewritings - nickname to given name, given name to initial or
short form, order of the parts, kind words, legal forms and their abbreviations, spellings that languages share, and
the name with one letter left out, which meets every slip of one letter - are written out as forms; entries are linked
by an equi-join on the form.

A form is scored by its rarity: 1 / the identities that own it. Links need a rarity of at least MIN_RARITY. Weak
forms (initials, short forms, the bare family name, a place without its kind) link only where one identity owns them.
A form whose owners bear different titles, legal forms or middle initials is not one name: there, entries link only
with those that bear the same, and one that bears none links with none of them.

No group is collected: a form links its members to its smallest entry (a star), and the components are found
by label propagation over tables cut at the checkpoint folder.

Defined results: entries of the types event, item, phrase, date_or_time and other, ordinary vocabulary and
entries without letters give no link; repeated ids count once; null source terms leave the target alone to
speak; a null project gives no link. Middle initials count where both sides of an entry agree on them. Names of
under SHORT_NAME letters have no form with a letter left out. An entry that slips alike on both sides is a name of
its own, unless the spellings are ones that languages share (Perez, Peres).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillmill.llm import textnorm
from quillmill.operators.graph import components
from quillmill.operators.resolution import parts
from quillmill.runtime import cut_lineage, latest_by_id

# Legal forms of companies in public use, by form.
LEGAL = {
    "limited": "ltd limited ltda limitada lda", "incorporated": "inc incorporated", "corporation": "corp corporation", "llc": "llc", "plc": "plc", "llp": "llp", "gmbh": "gmbh mbh",
    "ag": "ag aktiengesellschaft", "kg": "kg", "ohg": "ohg", "sa": "sa", "sas": "sas", "sarl": "sarl", "sl": "sl slu", "srl": "srl", "spa": "spa", "bv": "bv", "nv": "nv", "oy": "oy oyj", "asa": "asa", "pty": "pty",
    "kk": "kk 株式会社", "lp": "lp", "se": "se", "ev": "ev",
}
# Words that name a title, a kind of place or organisation, an ordinal or an epithet.
TITLES = {
    "captain": "captain capitan capitao capitaine kapitan 船長 capt cap kap kapt",
    "professor": "professor profesor professeur 教授 prof",
    "doctor": "doctor doutor docteur doktor 博士 dr dra",
    "sergeant": "sergeant sargento sergent feldwebel 軍曹 sgt sgto fw serg",
    "lady": "lady dama dame 夫人 ly",
    "brother": "brother hermano irmao frere bruder 修道士 br ir fr hno",
    "mister": "mr mister monsieur herr", "missus": "mrs missus madame frau", "miss": "miss ms mademoiselle fraulein", "sir": "sir", "lord": "lord",
    "king": "king konig", "queen": "queen konigin reina rainha", "general": "general", "colonel": "colonel coronel", "major": "major", "lieutenant": "lieutenant teniente tenente leutnant",
    "father": "father", "sister": "sister schwester", "uncle": "uncle onkel", "aunt": "aunt tante", "count": "count conde graf", "duke": "duke duque herzog", "prince": "prince", "princess": "princess princesa princesse",
}
PLACES = {
    "harbour": "harbour harbor puerto porto port hafen 港 hbr pto hfn",
    "forest": "forest bosque floresta foret forst 森 frst fst for bsq flor",
    "castle": "castle castillo castelo chateau burg 城 cstl cast chat bg",
    "island": "island isla ilha ile insel 島 isl",
    "abbey": "abbey abadia abbaye abtei 僧院 ab abb abt",
    "river": "river rio riviere fluss", "lake": "lake lago lac", "mountain": "mountain mount monte mont berg", "valley": "valley valle vallee", "city": "city ciudad cidade ville stadt",
    "bay": "bay bahia baie bucht", "bridge": "bridge puente ponte pont brucke", "street": "street calle rua strasse", "square": "square plaza praca platz", "palace": "palace palacio palais palast",
}
BODIES = {
    "brotherhood": "brotherhood hermandad irmandade confrerie bruderschaft 同胞団 brhd irm hdad confr brsch",
    "printing": "printing impresora impressora imprimerie dimprimerie druckerei 印刷所 prtg impr dimpr druck",
    "trading": "trading comercial commerciale handelsgesellschaft 商会 trdg comm handelsges com",
    "academy": "academy academia academie akademie 学院 acad akad",
    "university": "university universidad universidade universite universitat univ", "bank": "bank banco banque", "church": "church iglesia igreja eglise kirche",
    "hospital": "hospital hopital krankenhaus", "museum": "museum museo museu musee", "institute": "institute instituto institut inst", "ministry": "ministry ministerio ministere ministerium",
    "society": "society sociedad sociedade societe gesellschaft soc", "school": "school escuela escola ecole schule", "library": "library biblioteca bibliotheque bibliothek",
}
FILLERS = "house casa maison company compania companhia compagnie hse mais co cia cie"
ORDINALS = {"1": "first primera primeira premiere erste primero primeiro premier erster 第一 1st 1a 1", "2": "second segunda seconde zweite segundo second zweiter deuxieme 第二 2nd 2a 2"}
EPITHETS = {"younger": "younger mozo moco jeune jungere 若 jr", "elder": "elder viejo velho lancien ancien altere 老 sr"}
ARTICLES = "the a an el la los las le les l o os as die der das de of do da dos das du des d von vom y e et und"
#: Articles that open ordinary vocabulary: in lower case before a small letter, and in German, where all nouns are capital.
VOCABULARY = re.compile(r"^(?:(?:the|an?|el|la|los|las|les?|l'|d'|o|os|as|un|una|um|uma|une)(?:\s|(?<='))(?=\s*[^\W\d_])(?!\s*[A-ZÀ-ÖØ-Þ])|(?:die|der|das|ein|eine)\s)", re.U)

_LEX: dict[str, tuple[str, str]] = {}
for _group, _table in (("title", TITLES), ("place", PLACES), ("body", BODIES), ("ord", ORDINALS), ("epi", EPITHETS)):
    for _name, _words in _table.items():
        for _w in _words.split():
            _LEX.setdefault(_w, (_group, _name))
for _w in FILLERS.split():
    _LEX.setdefault(_w, ("fill", ""))
for _w in ARTICLES.split():
    _LEX.setdefault(_w, ("art", ""))
_LEGAL = {_w: _name for _name, _words in LEGAL.items() for _w in _words.split()}


def _deletes(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


_FUZZY: dict[str, tuple[str, str]] = {}
for _w, _v in _LEX.items():
    if len(_w) >= 5 and _w.isascii() and _v[0] in ("title", "place", "body", "epi", "fill"):
        for _d in _deletes(_w) | {_w}:
            _FUZZY.setdefault(_d, _v)

#: Short kind words with any one letter changed or left out, for what stands beside a longer word (Isle de, Cesa).
_SHORT: dict[str, tuple[str, str]] = {}
for _w, _v in _LEX.items():
    if 3 <= len(_w) <= 4 and _w.isascii() and _v[0] in ("place", "body", "fill"):
        for _d in (_w, *sorted(_deletes(_w)), *(_w[:k] + "*" + _w[k + 1 :] for k in range(len(_w)))):
            _SHORT.setdefault(_d, _v)


def _short_kind(word: str) -> tuple[str, str] | None:
    for d in (word, *(word[:k] + "*" + word[k + 1 :] for k in range(len(word)))):
        if d in _SHORT:
            return _SHORT[d]
    return None


_PIECES = re.compile(r"[぀-ヿ㐀-鿿々]+|[^\W\d_぀-ヿ㐀-鿿々]+|\d\w*", re.U)
_ACRONYM = re.compile(r"\b(?:[a-z]\.){2,}")
_SHARED_SPELLING = re.compile(r"ez$")
_VOWELS = frozenset("aeiouy")


def _title_of(word: str) -> str | None:
    """The title that a dotted word without vowels after its first letter shortens (Kpt., Sgt.)."""
    if len(word) < 2 or _VOWELS & set(word[1:]):
        return None
    for name, words in TITLES.items():
        for w in words.split():
            rest = iter(w)
            if w[0] == word[0] and all(c in rest for c in word):
                return name
    return None


ENTITY_TYPES = ("character", "place", "organization", "term")


def spelling(word: str) -> str:
    """One spelling of an ending that languages write in two ways (Perez, Peres)."""
    return _SHARED_SPELLING.sub("es", word)


def fold(text: str) -> str:
    """Latin letters without accents, in lower case."""
    out = unicodedata.normalize("NFD", text.replace("ß", "ss").casefold())
    return unicodedata.normalize("NFC", "".join(c for c in out if not unicodedata.combining(c)))


def _latin(text: str) -> str:
    """The text with tokens of look-alikes in Latin letters where all of a token can be."""
    text = textnorm.repair_characters(text)
    if textnorm.FOREIGN.search(text):
        text = textnorm.TOKEN.sub(lambda m: textnorm.render(m.group(), "latin") or m.group(), text)
    return text


def _classify(word: str) -> tuple[str, str] | None:
    hit = _LEX.get(word)
    if hit is None and len(word) >= 5:
        for d in (word, *sorted(_deletes(word))):
            hit = _FUZZY.get(d)
            if hit:
                break
    return hit


def parse(term: str | None, etype: str) -> dict | None:
    """The parts of one side of an entry, or None where it has none. etype: person, other or '' if unknown."""
    if term is None:
        return None
    text = _latin(term)
    if not any(c.isalpha() for c in text):
        return None
    vocabulary = bool(VOCABULARY.match(text))
    folded = fold(text).replace("’", "'")
    comma = "," in folded
    folded = re.sub(r"\b([dl])'", r"\1", folded) if re.search(r"\b[dl]'(?:imp|anc)", folded) else folded.replace("'", " ")
    out: dict = {"title": set(), "place": set(), "body": set(), "ord": set(), "epi": set(), "legal": set()}
    company = etype in ("organization", "term")
    if company:
        folded = _ACRONYM.sub(lambda m: m.group().replace(".", "") + " " if m.group().replace(".", "") in _LEGAL else m.group(), folded)
    names: list[tuple[str, bool]] = []
    plain = not comma  # written in full: no slip in a kind word or title, nothing shortened, no parts swapped
    for m in _PIECES.finditer(folded):
        w, dot = m.group(), folded[m.end() : m.end() + 1] == "."
        plain = plain and not dot
        if not w.isascii() and not w[0].isascii() and len(w) > 1 and w not in _LEX and "぀" <= w[0] <= "鿿":
            for part in re.findall(r"第[一二]|船長|教授|博士|軍曹|夫人|修道士|僧院|同胞団|印刷所|商会|学院|[港森城島老若]", w):
                g, n = _LEX[part]
                out[g].add(n)
            continue
        if len(w) == 1 and dot:
            names.append((w, True))
            continue
        if company and w in _LEGAL:
            out["legal"].add(_LEGAL[w])
            continue
        hit = _classify(w)
        if hit and not (dot is False and hit[0] in ("title", "place", "body", "fill") and len(w) <= 3 and w.isascii() and w not in ("ile",) and w != "co"):
            plain = plain and w in _LEX
            if hit[0] in out:
                out[hit[0]].add(hit[1])
            continue
        title = _title_of(w) if dot else None
        if title:
            out["title"].add(title)
            continue
        names.append((w, dot))
    if (etype in ("place", "organization") or out["place"] or out["body"]) and len(names) > 1 and any(len(w) >= 5 for w, _ in names):
        kinds = {w: _short_kind(w) for w, dot in names if not dot and 2 <= len(w) <= 4 and w.isascii()}
        for w, hit in kinds.items():
            if hit:
                plain = False
                if hit[0] in out:
                    out[hit[0]].add(hit[1])
        names = [(w, d) for w, d in names if not kinds.get(w)]
    names = [(spelling(w), d) for w, d in names]
    out["plain"] = plain
    out["vocabulary"] = vocabulary and not (out["place"] or out["body"] or out["title"] or out["ord"] or out["legal"])
    out["comma"], out["names"] = comma, names
    return out


def _side(parts: dict, person: bool) -> tuple[str | None, list[str], list[str], list[str], str]:
    """(name, full given names, short forms, initials, initials of what stands in the middle)"""
    names = parts["names"]
    full = [(w, d) for w, d in names if len(w) > 1]
    if not full:
        return None, [], [], [], ""
    if not person:
        return " ".join(sorted([w for w, d in full if not d] or [w for w, d in full])), [], [], [], ""
    solid = [k for k, (w, d) in enumerate(names) if len(w) > 1 and not d]
    if not solid:
        return None, [], [], [], ""
    at = solid[0] if parts["comma"] else solid[-1]
    core = names[at][0]
    rest = [n for k, n in enumerate(names) if k != at]
    first = next((k for k, (w, d) in enumerate(rest) if len(w) > 1 and not d), None)
    short = [] if first is not None else [k for k, (w, d) in enumerate(rest) if len(w) > 1][:1]
    lead = first if first is not None else short[0] if short else 0
    middle = "".join(w[0] for k, (w, d) in enumerate(rest) if k != lead)
    shorts = [w for w, d in rest if len(w) > 1 and d][:1]
    initials = [rest[0][0]] if rest and first is None and not shorts and len(rest[0][0]) == 1 else []
    return core, [rest[first][0]] if first is not None else [], shorts, initials, middle


def analyse(etype: str, source: str | None, target: str | None) -> dict | None:
    """Everything an entry says about the entity it names; None where it names none."""
    if etype not in ENTITY_TYPES:
        return None
    sides = [p for p in (parse(source, etype), parse(target, etype)) if p]
    if not sides or any(p["vocabulary"] for p in sides):
        return None
    union = {k: set().union(*(p[k] for p in sides)) for k in ("title", "place", "body", "ord", "epi", "legal")}
    if etype == "term":
        kind = "organization" if union["body"] or union["legal"] else "place" if union["place"] else "character"
    else:
        kind = etype
    person = kind == "character"
    cores, given, short, initials, middles = set(), set(), set(), set(), []
    for p in sides:
        c, g, s, i, m = _side(p, person)
        if c:
            cores.add(c)
            middles.append(m)
        given.update(g), short.update(s), initials.update(i)
    if not cores:
        return None
    marks = union["title"] if person else union["legal"] if kind == "organization" else ()
    middle = middles[0] if len(middles) == 2 and middles[0] == middles[1] else ""
    return {
        "kind": kind,
        "what": "+".join(sorted(union["body"] if kind == "organization" else union["place"] if kind == "place" else ())),
        "ord": "+".join(sorted(union["ord"])) if not person else "",
        "epi": "+".join(sorted(union["epi"])) if person else "",
        "mark": next(iter(marks)) if len(marks) == 1 else "", "middle": middle,
        "sure": len(middles) == 2 and len(cores) == 1 and len(given) == person and all(p["plain"] and (not person or len(p["names"]) <= 2 + len(middle)) for p in sides),
        "cores": sorted(cores), "given": sorted(given), "short": sorted(short), "initials": sorted(initials),
    }


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["project_id", "id", "kind", "what", "ord", "epi", "mark", "middle", "sure", "cores", "given", "short", "initials"]
    for pdf in batches:
        rows = []
        for project, i, t, s, u in zip(pdf["project_id"], pdf["id"], pdf["type"], pdf["source_term"], pdf["target_term"]):
            a = analyse(t, s, u)
            if a:
                rows.append((project, i, *(a[c] for c in cols[2:])))
        yield pd.DataFrame(rows, columns=cols)


PARSED = (
    "project_id string, id string, kind string, what string, ord string, epi string, mark string, middle string, "
    "sure boolean, cores array<string>, given array<string>, short array<string>, initials array<string>"
)
#: Names of fewer letters have no form with a letter left out.
SHORT_NAME = 4


KEY = ["k1", "k2"]
STRONG, NEAR, OWNER, SEEKER = 0, 1, 2, 3
#: What share of the identities that own a form an entry's link must rest on.
MIN_RARITY = 1.0
#: At most so many split forms (two numbers and two flags each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_FORMS = 100_000
def _left_out(word: Column) -> Column:
    """The word, and where it is no short name the word with each one letter left out."""
    gaps = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= SHORT_NAME, gaps).otherwise(F.array().cast("array<string>"))))


def _forms(parsed: DataFrame) -> DataFrame:
    """(nid, project_id, form, role, lead, mark, middle): all rewritings of every entry, written out by expressions.

    Strong forms name the entity in full, near ones with a letter left out. Owner and seeker forms hold the name alone;
    `lead` is the given name of an owner, and what a seeker has of one: an initial, a short form or nothing.
    """
    c, g, v, e = F.col("core"), F.col("g"), F.col("v"), F.col("e")
    base = parsed.select("nid", "project_id", "kind", "what", "ord", "epi", "mark", "middle", "given", "short", "initials", F.explode("cores").alias("core"))
    bar = lambda *parts: F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    role = F.when(v == c, STRONG).otherwise(NEAR)
    put = lambda df, form, how, lead="": df.select("nid", "project_id", form.alias("form"), (how if isinstance(how, Column) else F.lit(how)).cast("int").alias("role"), (lead if isinstance(lead, Column) else F.lit(lead)).alias("lead"), "mark", "middle")
    spelled = base.withColumn("v", F.explode(_left_out(c)))
    other, person = F.col("kind") != "character", F.col("kind") == "character"
    named = person & (F.size("given") > 0)
    told = F.array_distinct(F.concat("short", "initials"))
    who = F.coalesce(F.nullif("epi", F.lit("")), F.lit("*"))
    parts_ = [
        put(spelled.where(other), bar(F.col("kind"), F.col("what"), F.col("ord"), v), role),
        put(base.where(other), bar(F.col("kind"), "?", F.col("ord"), c), F.when(F.col("what") != "", OWNER).otherwise(SEEKER)),
        put(spelled.where(named).withColumn("g", F.explode("given")), bar("p", F.col("epi"), g, v), role),
        put(base.where(named).withColumn("g", F.explode("given")).where(F.length("g") >= SHORT_NAME).withColumn("v", F.explode(_left_out(g))), bar("p", F.col("epi"), F.concat(v, F.lit("~")), c), NEAR),
        put(spelled.where(named).withColumn("g", F.explode("given")).withColumn("e", F.explode(F.array_distinct(F.array(who, F.lit("*"))))), bar("n", e, v), OWNER, g),
        put(spelled.where(person & (F.size("given") == 0)).withColumn("g", F.explode(F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(""))))), bar("n", who, v), SEEKER, g),
    ]
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionByName(p)
    return out


def _keyed(forms: DataFrame) -> DataFrame:
    """Forms as 128 bits of hash, so that what is shuffled is short; where owners bear different marks or middle initials these are part of the form."""
    key = lambda n: F.xxhash64(F.lit(n), "project_id", "form").alias(f"k{n}")
    keyed = cut_lineage(forms.select(key(1), key(2), "nid", "role", "lead", F.nullif("mark", F.lit("")).alias("mark"), F.nullif("middle", F.lit("")).alias("middle")))
    apart = cut_lineage(
        keyed.where((F.col("role") <= NEAR) & (F.col("mark").isNotNull() | F.col("middle").isNotNull())).groupBy(*KEY)
        .agg((F.min("mark") != F.max("mark")).alias("by_mark"), (F.min("middle") != F.max("middle")).alias("by_middle")).where("by_mark OR by_middle")
    )
    split = F.when(F.col("role") <= NEAR, F.struct(F.when(F.col("by_mark"), F.coalesce("mark", F.lit(""))).alias("a"), F.when(F.col("by_middle"), F.coalesce("middle", F.lit(""))).alias("b")))
    few = apart.count() <= BROADCAST_FORMS
    out = keyed.join(F.broadcast(apart) if few else apart, KEY, "left").select(
        *[F.when((F.col("role") <= NEAR) & (F.col("by_mark") | F.col("by_middle")), F.xxhash64(k, split)).otherwise(F.col(k)).alias(k) for k in KEY], "nid", "role", "lead", "mark")
    return out if few else cut_lineage(out)


def distinct_spellings(entries: DataFrame) -> DataFrame:
    """(project_id, type, source_term, target_term, id, entry): each entry with the smallest id of its exact copies.

    Copies are told apart no further: the rest of the work sees one row for each way of writing, however often it occurs.
    """
    latest = latest_by_id(entries.select("id", "project_id", "type", "source_term", "target_term", *[c for c in ("loaded_at",) if c in entries.columns]))
    kept = latest.where(F.col("type").isin(*ENTITY_TYPES) & F.col("project_id").isNotNull() & F.col("id").isNotNull())
    spelling = ["project_id", "type", "source_term", "target_term"]
    copied = kept.select(F.col("id").alias("entry"), F.xxhash64(*spelling).alias("_h"), *spelling)
    firsts = copied.groupBy("_h", *spelling).agg(F.min("entry").alias("id")).select("id", F.col("_h").alias("_g"), *[F.col(c).alias(f"_{c}") for c in spelling])
    same = F.col("_h") == F.col("_g")
    for c in spelling:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return copied.join(firsts, same).select(*spelling, "id", "entry")


def parse_spellings(spellings: DataFrame) -> DataFrame:
    return spellings.where("id = entry").select("project_id", "id", "type", "source_term", "target_term").mapInPandas(_parsed, PARSED)


def _with_nicknames(parsed: DataFrame, nickname: DataFrame) -> DataFrame:
    """Given names by which each entry may also go: listed nicknames, and those that two entries show side by side."""
    spelled = lambda c: F.regexp_replace(F.lower(c), "ez$", "es")
    listed = nickname.where("given_name IS NOT NULL AND nickname IS NOT NULL").select(spelled("nickname").alias("nick"), spelled("given_name").alias("name"))
    two = parsed.where("kind = 'character' AND size(given) = 2")
    seen = (
        two.select(F.col("given")[0].alias("a"), F.col("given")[1].alias("b"), "project_id")
        .where("length(a) >= 3 AND length(b) >= 3")
        .select(F.explode(F.array(F.struct(F.col("a").alias("nick"), F.col("b").alias("name")), F.struct(F.col("b").alias("nick"), F.col("a").alias("name")))).alias("p"), "project_id")
        .groupBy("p").agg(F.countDistinct("project_id").alias("n")).where("n >= 2").select("p.*")
        .where("length(nick) < length(name) OR (length(nick) = length(name) AND nick < name)")
    )
    table = listed.unionByName(seen).distinct()
    more = (
        parsed.where("kind = 'character'").select("project_id", "id", F.explode("given").alias("nick"))
        .join(table, "nick").groupBy("project_id", "id").agg(F.collect_set("name").alias("more"))
    )
    return parsed.join(more, ["project_id", "id"], "left").withColumn("given", F.array_union("given", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def _near_edges(parsed: DataFrame, forms: DataFrame, exact: DataFrame) -> DataFrame:
    """Edges (a, b, form, rarity) between exact identities that meet in a form with a letter left out.

    An identity that some entry spells in full and alike on both sides is sure: whoever shortens nothing and slips nowhere
    else seldom makes one slip twice. Two sure identities are never joined by near forms; any other goes to the one sure
    identity that it shares most forms with, and only those that meet none go together.
    """
    sure = parsed.where("sure AND size(given) <= 1").select("nid").join(exact, "nid").select("root").distinct().withColumn("sure", F.lit(True))
    met = forms.where(F.col("role") <= NEAR).select(*KEY, "nid").join(exact, "nid").select(*KEY, "root").distinct()
    many = met.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    met = cut_lineage(met.join(many, KEY, "left_semi").join(sure, "root", "left"))
    loose, held = met.where("sure IS NULL").select(*KEY, F.col("root").alias("a")), met.where("sure").select(*KEY, F.col("root").alias("b"))
    shared = cut_lineage(loose.join(held, KEY).groupBy("a", "b").agg(F.count("*").alias("n")))
    best = shared.groupBy("a").agg(F.max("n").alias("n"))
    to_sure = shared.join(best, ["a", "n"]).groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("owners"))
    free = loose.join(shared.select("a").distinct(), "a", "left_anti")
    stars = free.groupBy(*KEY).agg(F.min("a").alias("b"))
    return _scored(to_sure, "near").unionByName(_scored(free.join(stars, KEY).where("a <> b").select("a", "b", F.lit(1).alias("owners")).distinct(), "near"))


def _scored(edges: DataFrame, form: str) -> DataFrame:
    """edges(a, b, owners) -> (a, b, form, rarity)"""
    return edges.select("a", "b", F.lit(form).alias("form"), (1 / F.col("owners")).alias("rarity"))


def _weak_edges(forms: DataFrame, first: DataFrame) -> DataFrame:
    """Edges (a, b, form, rarity) of entries without a given name: rarity is one over the number of identities that own the form."""
    seekers = cut_lineage(forms.where(F.col("role") == SEEKER).select(*KEY, F.col("nid").alias("a"), F.col("lead").alias("begins"), "mark"))
    wanted = seekers.select(*KEY).distinct()
    owners = forms.where(F.col("role") == OWNER).join(wanted, KEY, "left_semi").join(first, "nid").select(*KEY, "lead", "root").distinct()
    met = cut_lineage(seekers.join(owners, KEY).where(F.col("lead").startswith(F.col("begins"))).groupBy("a").agg(F.min("root").alias("b"), F.countDistinct("root").alias("owners")))
    lonely = seekers.join(met.select("a"), "a", "left_anti")
    apart = lonely.groupBy(*KEY, "begins").agg((F.min("mark") != F.max("mark")).alias("by_mark"))
    lonely = lonely.join(apart, [*KEY, "begins"]).withColumn("side", F.when(F.col("by_mark"), F.coalesce("mark", F.lit(""))).otherwise(""))
    stars = lonely.groupBy(*KEY, "begins", "side").agg(F.min("a").alias("b"))
    among = lonely.join(stars, [*KEY, "begins", "side"]).where("a <> b").select("a", "b", F.lit(1).alias("owners")).distinct()
    return _scored(met, "weak").unionByName(_scored(among, "weak"))


def _roots(parsed: DataFrame, *edges: DataFrame) -> DataFrame:
    """(nid, root) under all the given edges."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    return cut_lineage(components(parsed.select(F.col("nid").alias("id")), every).withColumnRenamed("id", "nid"))


def _resolve(entries: DataFrame, nickname: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(spellings, parsed, final roots, scored edges of each stage)"""
    spellings = cut_lineage(distinct_spellings(entries))
    # numbers stand for ids from here on; they are written with the rows, so they hold
    parsed = cut_lineage(_with_nicknames(cut_lineage(parse_spellings(spellings)), nickname).withColumn("nid", F.monotonically_increasing_id()))
    forms = _keyed(_forms(parsed))
    strong = forms.where(F.col("role") == STRONG)
    reps = strong.groupBy(*KEY).agg(F.min("nid").alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = _scored(strong.join(reps, KEY).where("nid <> rep").select(F.col("nid").alias("a"), F.col("rep").alias("b"), F.lit(1).alias("owners")).distinct(), "full")
    exact = _roots(parsed, same.select("a", "b"))
    near = cut_lineage(_near_edges(parsed, forms, exact))
    first = _roots(parsed, _as_edges(exact), _rare(near))
    weak = cut_lineage(_weak_edges(forms, first))
    slips = cut_lineage(_two_slips(parsed, first, spellings))
    final = _roots(parsed, _as_edges(first), _rare(weak), slips)
    return spellings, parsed, final, [same, near, weak]


def _rare(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("rarity") >= MIN_RARITY).select("a", "b")


def link_entries(entries: DataFrame, nickname: DataFrame) -> DataFrame:
    """entries -> (project_id, id, kind, root): entries with the same root, the smallest of their ids, name the same entity."""
    spellings, parsed, final, _ = _resolve(entries, nickname)
    named = parsed.select("nid", "project_id", "id", "kind").join(final, "nid")
    names_of = named.groupBy("root").agg(F.min("id").alias("smallest"))
    named = named.join(names_of, "root").select("project_id", "id", "kind", F.col("smallest").alias("root"))
    return spellings.select("id", "entry").join(named, "id").select("project_id", F.col("entry").alias("id"), "kind", "root")


def scored_links(entries: DataFrame, nickname: DataFrame) -> DataFrame:
    """(project_id, id, other_id, form, rarity, linked): what entries meet in, with the rarity that decides; one row per pair of ways of writing."""
    _, parsed, _, edges = _resolve(entries, nickname)
    met = edges[0].unionByName(edges[1]).unionByName(edges[2]).groupBy("a", "b", "form").agg(F.max("rarity").alias("rarity"))
    one, two = parsed.select(F.col("nid").alias("a"), "project_id", "id"), parsed.select(F.col("nid").alias("b"), F.col("id").alias("other_id"))
    return met.join(one, "a").join(two, "b").select("project_id", "id", "other_id", "form", F.round("rarity", 6).alias("rarity"), (F.col("rarity") >= MIN_RARITY).alias("linked"))


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.where("nid <> root").select(F.col("nid").alias("a"), F.col("root").alias("b"))


#: Names at least so long may differ by two slips on every side, where nothing else holds an entry.
LONG_NAME = 8


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three parts of each name, and for entries that look (`lost`) the places where such a part may stand two slips away."""
    for pdf in batches:
        rows = set()
        for r in pdf.itertuples(index=False):
            scopes = [f"p|{r.epi}|{g}" for g in r.given] if r.kind == "character" else [f"{r.kind}|{r.what}|{r.ord}"]
            for core in r.cores:
                n = len(core)
                if n < LONG_NAME:
                    continue
                for s in scopes:
                    if not r.lost:
                        rows.update((r.project_id, s, n, i, core[a : a + size], r.nid, core, False) for i, (a, size) in enumerate(parts(n)))
                        continue
                    for m in range(n - 2, n + 3):
                        for i, (a, size) in enumerate(parts(m)):
                            rows.update((r.project_id, s, m, i, core[p : p + size], r.nid, core, True) for p in range(max(0, a - 2), min(n - size, a + 2) + 1))
        yield pd.DataFrame(sorted(rows), columns=["project_id", "scope", "len", "part", "piece", "nid", "core", "lost"])


def _two_slips(parsed: DataFrame, first: DataFrame, spellings: DataFrame) -> DataFrame:
    """Edges (a, b) of entries that stand alone and show a slip: one side only, or sides that disagree.

    Their name is compared, within two edits, with the names of the same project, kind and given name; a link is made
    only where all that is met is one identity.
    """
    sizes = first.groupBy("root").agg(F.count("*").alias("n"))
    single = first.join(sizes.where("n = 1"), "root", "left_semi").select("nid")
    # copies of a spelling speak for it
    copied = spellings.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1").select("id")
    one_sided = spellings.where("source_term IS NULL").select("id").distinct()
    alone = parsed.join(single, "nid", "left_semi").join(copied, "id", "left_anti")
    looking = alone.where("size(cores) > 1").select("nid").unionByName(alone.join(one_sided, "id", "left_semi").select("nid")).distinct()
    marked = parsed.join(looking.withColumn("lost", F.lit(True)), "nid", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    cut = cut_lineage(marked.select("project_id", "nid", "kind", "what", "ord", "epi", "cores", "given", "lost").mapInPandas(
        _pieces, "project_id string, scope string, len int, part int, piece string, nid long, core string, lost boolean"))
    key = ["project_id", "scope", "len", "part", "piece"]
    met = (
        cut.where("lost").select(*key, F.col("nid").alias("a"), F.col("core").alias("ca")).join(cut.where("NOT lost").select(*key, "nid", "core"), key)
        .where(F.levenshtein("ca", "core", 2) >= 0).select("a", "nid").distinct().join(first, "nid")
    )
    return met.groupBy("a").agg(F.min("root").alias("b"), F.max("root").alias("hi")).where("b = hi").select("a", "b")


#: Entries of one entity that are paired in one block.
BLOCK_ROWS = 1000


def entity_pairs(linked: DataFrame) -> DataFrame:
    """(left_id, right_id) of every two entries with one root, paired in salted blocks."""
    sizes = linked.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("blocks"))
    members = cut_lineage(linked.select("root", "id").join(sizes, "root"))
    left = members.select("root", F.col("id").alias("left_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = members.select("root", F.col("id").alias("right_id"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return left.join(right, ["root", "block"]).where("left_id < right_id").select("left_id", "right_id")
