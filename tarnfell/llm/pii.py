"""Personal data by weak supervision.

Labelers propose spans in whole texts: the regexes of the four base kinds with their checks (octets, Luhn, digit
counts), and looser ones for tokens that look like secrets, for account numbers (IBAN), national numbers and names
that the text announces.  Each candidate then gets votes: the *regex* labeler (does the strict form hold: a check
digit, a known shape?), the *gazetteer* (is the token that tells, a mail domain's end, an issuer's first digits, a
calling code, a vendor's prefix, a country, a given name, in the table?), the *context* (does the text before it end
in a word that announces such data, or in one that speaks against it?) and the *length*.  A labeler has no opinion
where it would only repeat what the pattern demands: the form of a national number can speak against it, not for it;
of a name the gazetteer also knows words that no name holds, and the context tells persons' names from those of files
and companies.  Expectation-maximisation on the counts of votes estimates each labeler's reliability and each kind's
share without any truth, leaning to what is believed of a labeler beforehand by the same part at every size; the
posteriors, as soft labels, then train the final span classifier: naive Bayes over the span's votes and shape.  Spans
of the base kinds whose checks hold always stay; of all others those stay that the classifier gives a half or more and
for which one labeler at least speaks, unless a base span or an account number covers them.

Base spans are leftmost and do not overlap within a kind; a match whose check fails is dropped without another try.
Quantifiers are possessive and starts are anchored at runs of their characters, which changes no match but keeps the
search linear, and Java's stack flat, on texts of any length.  Positions are sums over blocks of matches, covers are
looked up by halving and texts are put together from pieces of bounded length, so a text with very many spans takes
time in proportion to them.

Defined results: a null or empty text has no spans; offsets are code points, the end is exclusive; repeated rows are
looked at one by one; without any candidate the tables of the model are empty and nothing is added; further columns
stay as they are.

Native: DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions.binding import let
from tarnfell.llm.scratch import materialize

#: Kinds in the order in which spans with the same start are listed, and what finds their candidates.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:eyJ[A-Za-z0-9_-]{13,}+(?:\.[A-Za-z0-9_-]++){0,2}+|xox[a-z]-[A-Za-z0-9-]{10,}+|[A-Za-z0-9_]{16,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?<=(?:[Nn]ame is|[Nn]ame:|[Dd]ear|Mr\.|Mrs\.|Ms\.|Dr\.) )\p{Lu}\p{Ll}{1,30}+(?:[ -]\p{Lu}\p{Ll}{1,30}+){1,2}+",
}
BASE = ("email", "ip", "card", "phone")
#: Cheap tests of a whole text: where such a test fails the kind can't be there.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "secret": r"[A-Za-z0-9_]{16}|eyJ|xox[a-z]-",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "national": r"[0-9]-[0-9]{2}-[0-9]{4}",
    "name": r"[Nn]ame(?: is|:) |[Dd]ear |M(?:r|rs|s)\. |Dr\. ",
}
MASKS = {
    "email": "<EMAIL>",
    "ip": "<IP>",
    "card": "<CARD>",
    "phone": "<PHONE>",
    "secret": "<SECRET>",
    "iban": "<IBAN>",
    "national": "<NATIONAL_ID>",
    "name": "<NAME>",
}
CONTEXT = 40
#: Rounds of expectation-maximisation; candidates that the classifier is taken to have seen of each share beforehand.
ROUNDS, PRIOR = 12, 4.0
#: How often each labeler (in the order of ``VOTES``) is taken to be right beforehand, and what part of its votes that weighs.
BELIEF, TRUST = (0.95, 0.97, 0.95, 0.7), 0.05
#: Values summed at a time, and code points in a piece of a text.
BLOCK, PIECE = 128, 1024


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    parts = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(span: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)

    return F.forall(F.split(span, r"\."), small)


def mod97(span: Column) -> Column:
    """Whether an account number passes its check: moved by four, with letters as 10 to 35, it leaves 1."""
    bare = F.replace(span, F.lit(" "), F.lit(""))
    order = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c == "", rest).when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(order, ""), F.lit(0), step) == 1


def check(kind: str, span: Column) -> Column:
    """The strict form of a kind."""
    n = F.length(_digits(span))
    if kind == "iban":
        return mod97(span)
    if kind == "national":
        return ~span.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "name":
        return F.size(F.split(span, "[ -]")).between(2, 3)
    if kind == "ip":
        return _octets(span)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(span))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        letters, numbers = F.length(F.regexp_replace(span, r"[^A-Za-z]", "")), n
        mixed = span.rlike(r"^[A-Za-z0-9_]+$") & span.rlike("[a-z]") & span.rlike("[A-Z]")
        return span.rlike(_PREFIXED) | ((letters >= 3) & (numbers >= 3) & (span.rlike(r"^(?:[0-9a-f]+|[A-Z0-9]+)$") | mixed))
    return F.lit(True)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (whole numbers) what those before it come to, from 0; ``add`` is associative.

    An array that grows is copied at every step, so values are taken in blocks and blocks start from sums of blocks.
    """

    def within(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda s, v: F.struct(add(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(block, state, step, lambda s: s["out"])

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add))
        return F.flatten(F.zip_with(blocks, within(sums, F.lit(0)), within))

    def cut(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(all_, i, F.lit(BLOCK)))
        return F.when(F.size(all_) > 0, let(blocks, joined)).otherwise(F.expr("cast(array() as array<int>)"))

    return let(values, cut)


def _found(kind: str, text: Column) -> Column:
    """Array of (start, end, span, before): all candidates of a kind, by start."""
    pattern = F.lit(PATTERNS[kind])
    spans, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def placed(pairs: Column) -> Column:
        def item(p: Column, at: Column) -> Column:
            start = at + F.length(p["gap"])
            return F.struct(
                start.alias("start"),
                (start + F.length(p["span"])).alias("end"),
                p["span"].alias("span"),
                F.right(p["gap"], F.lit(CONTEXT)).alias("before"),
            )

        lengths = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["span"]))
        return F.zip_with(pairs, running(lengths, lambda x, y: x + y), item)

    # Each span comes after the text between it and the one before; the last gap has no span after it.
    pairs = F.zip_with(spans, F.slice(between, F.lit(1), F.size(spans)), lambda a, g: F.struct(a.alias("span"), g.alias("gap")))
    return let(pairs, placed)


_CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach)\W{0,4}$",
    "ip": r"(?i)(?:ip|address|host|server)\W{0,4}$",
    "card": r"(?i)(?:card|visa|credit|payment)\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile)\W{0,4}$",
    "secret": r"(?i)(?:token|password|passwd|secret|key|bearer)\W{0,5}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,4}$",
    "national": r"(?i)(?:ssn|social security(?: number| no\.?)?|national id|insurance number)\W{0,4}$",
    "name": r"(?:Mr|Mrs|Ms|Dr)\. $|(?i)(?<![a-z])(?:my|his|her|their|your|whose|full|first|patient(?:'s)?) name(?: is|:) $",
}
#: Words that announce a kind if they stand anywhere shortly before it, unless a word right before speaks against it.
_NEAR = {"national": r"(?i)(?<![a-z])(?:ssn|social security|national id|insurance number|taxpayer)(?![a-z])"}
_AGAINST = r"(?i)(?:version|release|isbn|order|invoice|section|figure|part|v)\W{0,3}$"
#: Things that have names, before "name is" or "name:".
_THINGS = (
    r"(?i)(?:file|folder|path|host|user|domain|server|product|company|brand|store|firm|team|project|place|street|city|column"
    r"|table|field|class|function|variable|event|course|song|book|movie|game|recipe|report|code|nick|screen)[ _-]?name(?: is|:) $"
)
#: What vendors' secrets begin with.
_PREFIXED = r"^(?:AKIA|ASIA|ghp_|gho_|xox|sk_|pk_|eyJ)"
#: The gazetteer: of each kind the tokens that speak for a span.  Octets, issuers and countries' codes are fixed values.
GAZETTEER: Mapping[str, Sequence[str]] = {
    "email": ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"],
    "ip": [str(i) for i in range(1, 224) if i != 127],
    "card": ["30", "34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65"],
    "phone": [
        "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
        "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
        "91", "92", "93", "94", "95", "98", "351", "352", "353", "354", "358", "420", "421",
    ],
    "secret": ["AKIA", "ASIA", "ghp_", "gho_", "xoxa", "xoxb", "xoxp", "xoxr", "sk_", "pk_", "eyJ"],
    "iban": ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE"],
    "national": [],
    "name": [
        "Alice", "Anna", "Carlos", "David", "Elena", "Emma", "Eva", "Hans", "Jack", "James", "Jean", "John", "Jose", "Juan",
        "Julia", "Karl", "Laura", "Lucas", "Luis", "Maria", "Marie", "Mark", "Mary", "Michael", "Paul", "Pedro", "Peter",
        "Pierre", "Robert", "Sarah", "Sofia", "Thomas",
        "Adam", "Ahmed", "Aisha", "Alex", "Amir", "Amy", "Andrea", "Andrew", "Angela", "Anthony", "Barbara", "Ben", "Brian",
        "Charles", "Chen", "Chloe", "Chris", "Christine", "Claire", "Daniel", "Diana", "Edward", "Emily", "Eric", "Fatima",
        "Francesca", "Frank", "George", "Giulia", "Hannah", "Helen", "Henry", "Ivan", "Jane", "Jennifer", "Jessica", "Joe",
        "Jorge", "Joseph", "Karen", "Kate", "Kevin", "Kim", "Lena", "Leo", "Linda", "Lisa", "Luca", "Marco", "Martin",
        "Matthew", "Mei", "Mohammed", "Monica", "Nicolas", "Nina", "Nora", "Olga", "Oliver", "Olivia", "Omar", "Patricia",
        "Philip", "Priya", "Rachel", "Raj", "Richard", "Rosa", "Ryan", "Samuel", "Sandra", "Simon", "Stefan", "Steven",
        "Susan", "Tom", "Victor", "Wei", "William", "Yusuf",
    ],
}
#: Words that stand with capitals where a name could, and in no name.
NOT_NAMES = [
    "Account", "Admin", "Administrator", "Admissions", "All", "Annual", "Applicant", "Avenue", "Bank", "Board", "Candidate",
    "Chair", "Client", "Clients", "Colleague", "Colleagues", "Committee", "Community", "Company", "Council", "Customer",
    "Customers", "Data", "Department", "Diary", "Director", "Doctor", "Document", "Draft", "Editor", "Editors", "Everyone",
    "Family", "Fellow", "File", "Final", "Friend", "Friends", "General", "Governor", "Group", "Guest", "Guests", "Hiring",
    "Human", "Invoice", "Judge", "Ladies", "Gentlemen", "Lord", "Madam", "Main", "Management", "Manager", "Managers", "Mayor",
    "Member", "Members", "Minister", "Neighbor", "New", "Office", "Order", "Owner", "Page", "Parent", "Parents", "Partner",
    "Partners", "Patient", "President", "Prime", "Product", "Professor", "Project", "Reader", "Readers", "Recruiter", "Report",
    "Resident", "Resources", "Road", "Sales", "Santa", "Secretary", "Section", "Senator", "Server", "Service", "Services",
    "Shareholder", "Sir", "Sirs", "Staff", "Street", "Student", "Students", "Subscriber", "Supplier", "Support", "System",
    "Table", "Teacher", "Team", "Test", "The", "Travel", "User", "Users", "Valued", "Vendor", "Visitor", "Volunteer",
]


def _tokens(kind: str, span: Column) -> Column:
    """The parts of a span that the gazetteer is asked for."""
    digits = _digits(span)
    return {
        "email": lambda: F.array(F.lower(F.substring_index(span, ".", -1))),
        "ip": lambda: F.array(F.regexp_replace(F.substring_index(span, ".", 1), "^0+(?=[0-9])", "")),
        "card": lambda: F.array(F.left(digits, F.lit(1)), F.left(digits, F.lit(2))),
        "phone": lambda: F.array(*[F.left(digits, F.lit(n)) for n in (1, 2, 3)]),
        "secret": lambda: F.array(F.left(span, F.lit(3)), F.left(span, F.lit(4))),
        "iban": lambda: F.array(F.left(span, F.lit(2))),
        "national": lambda: F.array().cast("array<string>"),
        "name": lambda: F.split(span, "[ -]"),
    }[kind]()


_LENGTHS = {
    "email": (6, 64),
    "ip": (7, 15),
    "card": (13, 23),
    "phone": (10, 20),
    "secret": (16, 64),
    "iban": (15, 42),
    "national": (11, 11),
    "name": (5, 60),
}
VOTES = ("regex", "gazetteer", "context", "length")
_SPAN = "struct<order:int,kind:string,start:int,end:int,base:boolean,votes:array<int>,shape:array<string>>"


def _votes(kind: str, e: Column, gazetteer: Mapping[str, Sequence[str]]) -> Column:
    """1 for, 0 against, -1 for no opinion; in the order of ``VOTES``."""
    span, before, known = e["span"], e["before"], list(gazetteer.get(kind, ()))
    none = F.lit(0 if kind in ("ip", "card", "phone", "iban") else -1)
    listed = F.when(F.exists(_tokens(kind, span), lambda t: t.isin(known)), 1).otherwise(none) if known else F.lit(-1)
    context = F.when(before.rlike(_CONTEXT[kind]), 1).when(before.rlike(_AGAINST), 0)
    if kind == "name":
        listed = F.when(F.exists(_tokens(kind, span), lambda t: t.isin(NOT_NAMES)), 0).otherwise(listed)
        context = F.when(before.rlike(_THINGS), 0).otherwise(context)
    if kind in _NEAR:
        context = context.when(before.rlike(_NEAR[kind]), 1)
    strict, length = check(kind, span), F.length(span).between(*_LENGTHS[kind])
    # What the pattern of these two demands says nothing for them.
    speak = (lambda held: F.when(~held, 0).otherwise(-1)) if kind in ("national", "name") else (lambda held: held.cast("int"))
    return F.array(speak(strict), listed, F.coalesce(context, F.lit(-1)), speak(length))


def _shape(kind: str, e: Column, votes: Column) -> Column:
    """Names of the span's features: its length, its share of digits, its separators, its case, its votes."""
    span = e["span"]
    n, digits = F.length(span), F.length(_digits(span))
    marks = F.length(F.regexp_replace(span, r"[A-Za-z0-9]", ""))
    case = F.when(span.rlike("^[^A-Z]*$"), "l").when(span.rlike("^[^a-z]*$"), "u").otherwise("m")
    parts = [
        ("n", F.least(n.cast("int"), F.lit(64))),
        ("d", F.floor(10 * digits / n)),
        ("s", F.least(marks.cast("int"), F.lit(9))),
        ("c", case),
        *((VOTES[i][0] + "v", votes[i]) for i in range(3)),
    ]
    return F.array(*[F.concat(F.lit(f"{kind}.{k}"), v.cast("string")) for k, v in parts])


def _item(kind: str, order: int, gazetteer: Mapping[str, Sequence[str]]) -> Callable[[Column], Column]:
    def item(e: Column) -> Column:
        base = check(kind, e["span"]) if kind in BASE else F.lit(False)

        def made(votes: Column) -> Column:
            return F.struct(
                F.lit(order).alias("order"),
                F.lit(kind).alias("kind"),
                e["start"].alias("start"),
                e["end"].alias("end"),
                base.alias("base"),
                votes.alias("votes"),
                _shape(kind, e, votes).alias("shape"),
            )

        return F.get(F.transform(F.array(_votes(kind, e, gazetteer)), made), F.lit(0))  # votes are worked out once

    return item


def candidates(
    docs: DataFrame,
    text: str = "text",
    kinds: Sequence[str] = tuple(PATTERNS),
    gazetteer: Mapping[str, Sequence[str]] = GAZETTEER,
) -> DataFrame:
    """``docs`` with ``found``: an array of the candidates with their votes and shapes."""
    t, parts = F.coalesce(F.col(text), F.lit("")), []
    for i, kind in enumerate(kinds):
        likely = F.contains(t, F.lit(HINTS[kind])) if kind == "email" else t.rlike(HINTS[kind])
        wanted = (lambda e: e["span"].rlike("[0-9]") & e["span"].rlike("[A-Za-z]")) if kind == "secret" else (lambda e: F.lit(True))

        found = F.transform(F.filter(_found(kind, t), wanted), _item(kind, i, gazetteer))
        parts.append(F.when(likely, found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")))
    return docs.withColumn("found", F.concat(*parts))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``patterns`` (kind, votes, n) with ``posterior``: expectation-maximisation over a row for each pattern of votes.

    There are at most 3 patterns to the power of the labelers for a kind, kept together by one exchange.
    """
    w = W.partitionBy("kind")
    vote = [F.element_at("votes", j + 1) for j in range(len(VOTES))]
    cast_ = sum((F.when(v >= 0, 1.0).otherwise(0.0) for v in vote), F.lit(0.0))
    said = sum((F.when(v == 1, 1.0).otherwise(0.0) for v in vote), F.lit(0.0))
    rows = patterns.withColumn("posterior", (said + 0.5) / (cast_ + 1.0))
    for _ in range(rounds):
        p, n, more = F.col("posterior"), F.col("n"), {}
        more["_share"] = (F.sum(n * p).over(w) + 1) / (F.sum(n).over(w) + 2)
        for j, v in enumerate(vote):
            believed = F.greatest(F.lit(4.0), TRUST * F.sum(F.when(v >= 0, n).otherwise(0)).over(w))
            for name, weight, start in (("_hit", n * p, BELIEF[j]), ("_miss", n * (1 - p), 1 - BELIEF[j])):
                more[f"{name}{j}"] = (
                    F.sum(F.when(v == 1, weight).otherwise(0.0)).over(w)
                    + believed * start
                ) / (F.sum(F.when(v >= 0, weight).otherwise(0.0)).over(w) + believed)
        rows = rows.withColumns(more)
        odds = F.log(F.col("_share") / (1 - F.col("_share")))
        for j, v in enumerate(vote):
            hit, miss = F.col(f"_hit{j}"), F.col(f"_miss{j}")
            odds = odds + F.when(v == 1, F.log(hit / miss)).when(v == 0, F.log((1 - hit) / (1 - miss))).otherwise(0.0)
        rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rows.select("kind", "votes", "n", "posterior")


def train(found: DataFrame) -> DataFrame:
    """One row, ``model``: the log odds that each feature of a span adds (a few hundred entries, whatever the corpus)."""
    spans = found.select(F.explode("found").alias("e"))
    seen = spans.groupBy("e.kind", "e.votes", "e.shape").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen, "pii-patterns")
    known = reliabilities(seen.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    soft = seen.join(known.drop("n"), ["kind", "votes"])
    named = soft.select("n", "posterior", F.explode(F.concat(F.array(F.col("kind")), F.col("shape"))).alias("feature"))
    sums = named.groupBy("feature").agg(
        F.sum(F.col("n") * F.col("posterior")).alias("yes"),
        F.sum(F.col("n") * (1 - F.col("posterior"))).alias("no"),
    )
    w, kind_itself = W.partitionBy(F.substring_index("feature", ".", 1)), ~F.contains("feature", F.lit("."))
    all_yes, all_no = (F.max(F.when(kind_itself, F.col(c))).over(w) for c in ("yes", "no"))
    # Shares of a feature lean to what it has of all candidates, so that what was seen once or twice says little.
    lean = PRIOR * (F.col("yes") + F.col("no")) / (all_yes + all_no)
    share = F.log((F.col("yes") + lean) / (all_yes + PRIOR)) - F.log((F.col("no") + lean) / (all_no + PRIOR))
    odds = F.when(kind_itself, F.log((F.col("yes") + 1) / (F.col("no") + 1))).otherwise(share)
    sums = sums.withColumn("odds", odds)
    entries = sums.select(F.struct("feature", "odds").alias("entry"))
    return entries.agg(F.map_from_entries(F.collect_list("entry")).alias("model"))


def spans(found: DataFrame) -> DataFrame:
    """``found`` with ``spans``: base spans, and what the classifier adds that no base span covers, by start and then by kind."""
    model = materialize(train(found), "pii-model").scalar()

    def odds(e: Column) -> Column:
        return F.aggregate(
            F.concat(F.array(e["kind"]), e["shape"]),
            F.lit(0.0),
            lambda s, f: s + F.coalesce(F.element_at(F.col("__model"), f), F.lit(0.0)),
        )

    kept = F.filter(
        "found",
        lambda e: e["base"] | ((e["order"] >= len(BASE)) & F.exists(F.slice(e["votes"], 1, 3), lambda v: v == 1) & (odds(e) >= 0)),
    )
    over_kinds = (*BASE, "iban")
    by_kind = F.struct(*[F.filter("__kept", _of(k)).alias(k) for k in over_kinds])

    def uncovered(over: Column) -> Column:
        def free(e: Column) -> Column:
            covered = F.lit(False)
            for k in over_kinds:
                covered = covered | (F.lit(k) != e["kind"]) & _covers(over[k], e)
            return e["base"] | ~covered

        return F.filter("__kept", free)

    bare = F.transform(
        let(by_kind, uncovered),
        lambda e: F.struct(
            e["start"].alias("start"),
            e["order"].alias("order"),
            e["end"].alias("end"),
            e["kind"].alias("kind"),
            e["base"].alias("base"),
        ),
    )
    return found.withColumn("__model", model).withColumn("__kept", kept).withColumn("spans", F.array_sort(bare)).drop("__model", "__kept", "found")


def _covers(over: Column, e: Column) -> Column:
    """Whether a span of ``over``, which are sorted and don't overlap, holds ``e``: the last that starts no later, found by halving."""
    middle = lambda s: F.shiftright(s["low"] + s["high"], 1)

    def step(s: Column, _: Column) -> Column:
        early = F.get(over, middle(s))["start"] <= e["start"]
        low = F.when(early, middle(s) + 1).otherwise(s["low"])
        high = F.when(early, s["high"]).otherwise(middle(s))
        return F.when(s["low"] < s["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(s)

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(over))).cast("int"))
    state = F.struct(F.lit(0).alias("low"), F.size(over).alias("high"))
    last = F.aggregate(halvings, state, step, lambda s: s["low"] - 1)
    return F.when(F.size(over) > 0, let(last, lambda i: (i >= 0) & (F.get(over, i)["end"] >= e["end"]))).otherwise(False)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda e: e["kind"] == kind


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans of each document."""
    found = materialize(candidates(docs.select("doc_id", "text")).drop("text"), "pii-found")
    rows = spans(found)
    base = F.filter("spans", lambda e: e["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in pieces of ``PIECE``: only the pieces that they touch are read."""
    at = lambda place: F.floor(place / PIECE).cast("int")

    def part(piece: Column, i: Column) -> Column:
        first = F.when(i == 0, start % PIECE).otherwise(0)
        last = F.when(i == at(end) - at(start), end % PIECE).otherwise(PIECE)
        return F.substr(piece, first + 1, last - first)

    return F.array_join(F.transform(F.slice(pieces, at(start) + 1, at(end) - at(start) + 1), part), "")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by the name of its kind; overlapping spans give one name."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"))  # no column can clash
    rows = spans(materialize(candidates(held, "__text"), "pii-found"))
    masks = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])

    def masked(pieces: Column, listed: Column) -> Column:
        ends = F.transform(listed, lambda e: e["end"])

        def part(e: Column, at: Column) -> Column:
            return F.when(e["start"] >= at, F.concat(_between(pieces, at, e["start"]), F.element_at(masks, e["kind"]))).otherwise("")

        parts = F.zip_with(listed, running(ends, lambda a, b: F.greatest(a, b)), part)
        return F.concat(F.array_join(parts, ""), _between(pieces, F.array_max(ends), F.length("__text")))

    pieces = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    whole = let(F.struct(pieces.alias("pieces"), F.col("spans").alias("spans")), lambda x: masked(x["pieces"], x["spans"]))
    clean = F.when(F.size("spans") > 0, whole).otherwise(F.col("__text"))
    return rows.withColumn("__clean", clean).select(
        *[F.col("__clean").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns]
    )
