"""Jurisdictions that providers share: a catalogue, names to keys, and each provider's own courts.

The catalogue has a few hundred rows, whatever the data, so lookups against it are broadcast joins or map literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States by name with their postal code and CourtListener's ids of their appellate courts. Scholar numbers them from 1 in this order.
STATES = {
    "alabama": ("al", "ala alactapp alacrimapp alacivapp"),
    "alaska": ("ak", "alaska alaskactapp"),
    "arizona": ("az", "ariz arizctapp"),
    "arkansas": ("ar", "ark arkctapp"),
    "california": ("ca", "cal calctapp calappdeptsuper calctapp1d calctapp2d calctapp3d calctapp4d calctapp5d calctapp6d"),
    "colorado": ("co", "colo coloctapp"),
    "connecticut": ("ct", "conn connappct connsuperct"),
    "delaware": ("de", "del delch delorphct delsuperct"),
    "district of columbia": ("dc", "dc"),
    "florida": ("fl", "fla fladistctapp fladistctapp1 fladistctapp2 fladistctapp3 fladistctapp4 fladistctapp5 fladistctapp6"),
    "georgia": ("ga", "ga gactapp"),
    "hawaii": ("hi", "haw hawapp"),
    "idaho": ("id", "idaho idahoctapp"),
    "illinois": ("il", "ill illappct"),
    "indiana": ("in", "ind indctapp"),
    "iowa": ("ia", "iowa iowactapp"),
    "kansas": ("ks", "kan kanctapp"),
    "kentucky": ("ky", "ky kyctapp kyctapphigh"),
    "louisiana": ("la", "la lactapp"),
    "maine": ("me", "me"),
    "maryland": ("md", "md mdctspecapp"),
    "massachusetts": ("ma", "mass massappct massdistctapp masssuperct massdistct masstaxbd"),
    "michigan": ("mi", "mich michctapp"),
    "minnesota": ("mn", "minn minnctapp"),
    "mississippi": ("ms", "miss missctapp"),
    "missouri": ("mo", "mo moctapp moctapped moctappsd moctappwd"),
    "montana": ("mt", "mont"),
    "nebraska": ("ne", "neb nebctapp"),
    "nevada": ("nv", "nev nevapp"),
    "new hampshire": ("nh", "nh"),
    "new jersey": ("nj", "nj njsuperctappdiv"),
    "new mexico": ("nm", "nm nmctapp"),
    "new york": ("ny", "ny nyappdiv nyappterm nyhospcommn"),
    "north carolina": ("nc", "nc ncctapp ncsuperct"),
    "north dakota": ("nd", "nd ndctapp"),
    "ohio": ("oh", "ohio ohioctapp"),
    "oklahoma": ("ok", "okla oklacivapp oklacrimapp"),
    "oregon": ("or", "or orctapp"),
    "pennsylvania": ("pa", "pa pasuperct pacommwct"),
    "rhode island": ("ri", "ri risuperct"),
    "south carolina": ("sc", "sc scctapp"),
    "south dakota": ("sd", "sd"),
    "tennessee": ("tn", "tenn tennctapp tenncrimapp"),
    "texas": ("tx", " ".join(["tex texapp texcrimapp texjpml", *(f"txctapp{k}" for k in range(1, 14)), "txctapp13A txctapp13B txctapp14 txctapp15"])),
    "utah": ("ut", "utah utahctapp"),
    "vermont": ("vt", "vt vtsuperct"),
    "virginia": ("va", "va vactapp"),
    "washington": ("wa", "wash washctapp"),
    "west virginia": ("wv", "wva wvactapp"),
    "wisconsin": ("wi", "wis wisctapp"),
    "wyoming": ("wy", "wyo"),
}
# The circuits; Scholar's codes of their courts of appeals follow this order of names.
CIRCUITS = ("1st", "10th", "11th", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "dc", "federal")
FIRST_CIRCUIT_CODE = 119
# Places with one federal district, in the order of Scholar's codes from 134; None is a code of none of them.
ONE_DISTRICT = (
    "alaska", "arizona", None, "colorado", "connecticut", "delaware", "district of columbia", "guam", "hawaii", "idaho", "kansas", "maine", "maryland", "massachusetts", "minnesota", "montana",
    "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "north dakota", "oregon", "puerto rico", "rhode island", "south carolina", "south dakota", "utah", "vermont", "virgin islands", "wyoming",
)
FIRST_ONE = 134
# States with several, by first letters, in the order of Scholar's codes from 316.
DISTRICTS = {
    "alabama": "mns", "arkansas": "ew", "california": "cens", "florida": "mns", "georgia": "mns", "illinois": "cns", "indiana": "ns", "iowa": "ns", "kentucky": "ew", "louisiana": "emw",
    "michigan": "ew", "mississippi": "ns", "missouri": "ew", "new york": "ensw", "north carolina": "emw", "ohio": "ns", "oklahoma": "enw", "pennsylvania": "emw", "tennessee": "emw", "texas": "ensw",
    "virginia": "ew", "washington": "ew", "west virginia": "ns", "wisconsin": "ew",
}
FIRST_OF_SEVERAL = 316
SIDES = {"c": "central", "e": "eastern", "m": "middle", "n": "northern", "s": "southern", "w": "western"}
TERRITORIES = {"guam": "gu", "puerto rico": "pr", "virgin islands": "vi"}
# Districts whose names don't follow the rule: key and Scholar's name.
IRREGULAR = {
    "district of columbia": ("district court for the district of columbia", "dist of columbia"),
    "guam": ("district court of guam", "d guam"),
    "virgin islands": ("district of the virgin islands", "d virgin islands"),
    "minnesota": ("district of minnesota", "minnesota"),
}
# Ordinals as words.
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh".split(), (f"{k}{'st' if k == 1 else 'nd' if k == 2 else 'rd' if k == 3 else 'th'}" for k in range(1, 12)), strict=True))
SUPREME = "us supreme court"
ROW = "key string, kind string, scholar_courts array<string>, courtlistener_courts array<string>, aliases array<string>, scholar_code string, place int"


def catalogue_rows() -> list[tuple]:
    """Rows of ROW: all, the states, the Supreme Court and the circuits, the districts."""
    rows: list[tuple] = [("all", "all", [], [], ["all"], None)]
    for n, (name, (postal, ids)) in enumerate(STATES.items(), 1):
        rows.append((name, "state_appellate", [name], ids.split(), [name, postal], str(n)))
    rows.append((SUPREME, "federal_court", [SUPREME], ["scotus"], [SUPREME], "60"))
    codes = {c: str(FIRST_CIRCUIT_CODE + n) for n, c in enumerate(CIRCUITS)}
    for c in sorted(CIRCUITS, key=lambda c: (not c[0].isdigit(), int("".join(filter(str.isdigit, c)) or 0), c)):
        short = {"dc": "cadc", "federal": "cafc"}.get(c) or "ca" + "".join(filter(str.isdigit, c))
        rows.append((f"{c} circuit", "federal_court", [f"{c} circuit court of appeals"], [short], [f"{c} circuit"], codes[c]))
    place = lambda name: TERRITORIES.get(name) or STATES[name][0]
    for n, name in enumerate(ONE_DISTRICT):
        if name:
            key, scholar = IRREGULAR.get(name, (f"district of {name}", f"d {name}"))
            rows.append((key, "federal_district", [scholar], [f"{place(name)}d"], [key, scholar, f"{place(name)}d"], str(FIRST_ONE + n)))
    n = FIRST_OF_SEVERAL
    for name, sides in DISTRICTS.items():
        for s in sides:
            key, scholar, own = f"{SIDES[s]} district of {name}", f"{s}d {name}", f"{place(name)}{s}d"
            rows.append((key, "federal_district", [scholar], [own], [key, scholar, own], str(n)))
            n += 1
    return [(*r, i) for i, r in enumerate(rows)]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue_rows(), ROW)


def catalogue_groups(spark: SparkSession) -> DataFrame:
    """kind, count, jurisdictions of the catalogue in its order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda r: r["key"])
    return catalogue(spark).groupBy("kind").agg(F.count("*").alias("count"), listed.alias("jurisdictions"))


def validation_message(reason: str) -> str:
    keys = ", ".join(r[0] for r in catalogue_rows())
    return f"{reason}\nValid jurisdiction keys: {keys}.\nThe Northern Mariana Islands have no entry that both providers share."


def court_name(c: Column) -> Column:
    """A court's name as keys have it: ordinals as numbers, cir as circuit, the Supreme Court's many names as one, bare ordinals as circuits."""
    c = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    for word, number in ORDINALS.items():
        c = F.regexp_replace(c, rf"\b{word}\b", number)
    c = F.regexp_replace(c, r"\bcir\b", "circuit")
    supreme = c.rlike("^(scotus|us supreme( court)?|united states supreme( court)?|supreme( court)?)$")
    return F.when(supreme, SUPREME).when(c.rlike(r"^\d+(st|nd|rd|th)$"), F.concat(c, F.lit(" circuit"))).otherwise(c)


def resolve(df: DataFrame, column: str) -> DataFrame:
    """df with jurisdiction, jurisdiction_kind, scholar_courts, courtlistener_courts and jurisdiction_error.

    One name is resolved: lists and unknown names are errors, as is none at all.
    """
    spark = df.sparkSession
    aliases = catalogue(spark).select(F.explode("aliases").alias("_alias"), F.col("key").alias("jurisdiction"), F.col("kind").alias("jurisdiction_kind"), "scholar_courts", "courtlistener_courts")
    raw = F.col(column)
    single = F.when(F.lower(F.trim(raw)) == "all", "all").when(~F.contains(raw, F.lit(",")), court_name(raw))
    # "all" is a key only as it is written, not as what is left of another name
    single = F.when((single == "all") & (F.lower(F.trim(raw)) != "all"), None).otherwise(single)
    out = df.withColumn("_alias", single).join(F.broadcast(aliases), "_alias", "left").drop("_alias")
    error = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "required").when(F.contains(raw, F.lit(",")), "list").when(F.col("jurisdiction").isNull(), "unknown")
    return out.withColumn("jurisdiction_error", error)


def provider_courts(by: Column, scholar: Column, courtlistener: Column) -> Column:
    """The courts of a resolved jurisdiction for a provider; null where it has none or the provider can't filter by court."""
    mine = F.when(by == "scholar", scholar).when(by == "courtlistener", courtlistener)
    return F.when(F.size(mine) > 0, mine)


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


#: Federal courts that a list of names may have beside the catalogue's.
OTHER_FEDERAL = ("tax court", "court of claims")


def provider_filter(spec: Column, provider: str, native: bool = False) -> Column:
    """A comma list of courts in a provider's own terms, each once; null if none is given, '!' and the name where one is unknown.

    native: the values are the provider's own, so that CourtListener's ids pass as they are.
    """
    rows = [r for r in catalogue_rows() if r[0] != "all"]
    districts = {a: (r[2] if provider == "scholar" else r[3])[0] for r in rows if r[1] == "federal_district" for a in r[4]}
    own = {a: ",".join(r[2] if provider == "scholar" else r[3]) for r in rows if r[1] != "federal_district" for a in r[4]}
    if provider == "scholar":
        own |= {r[2][0]: r[2][0] for r in rows if r[1] == "federal_court"}
        if not native:
            own |= {n: n for n in OTHER_FEDERAL}

    def one(raw: Column) -> Column:
        name = court_name(raw)
        found = F.try_element_at(_table(districts), name)
        if provider == "courtlistener" and native:
            return F.coalesce(found, F.when(raw.rlike("^[A-Za-z][A-Za-z0-9-]*$"), raw).otherwise(F.concat(F.lit("!"), raw)))
        found = F.coalesce(found, F.try_element_at(_table(own), name))
        if provider == "courtlistener":
            found = F.coalesce(found, F.when(name.rlike("^[a-z][a-z0-9-]*$"), name))
        return F.coalesce(found, F.concat(F.lit("!"), raw))

    values = F.filter(F.transform(F.split(spec, ","), lambda v: F.trim(v)), lambda v: v != "")
    joined = F.array_join(F.array_distinct(F.flatten(F.transform(values, lambda v: F.split(one(v), ",")))), ",")
    return F.when(F.size(values) > 0, joined)


def scholar_codes(spec: Column, groups: dict[str, str] | None = None) -> Column:
    """A comma list of courts as Scholar's codes; null if one is unknown or none is given. groups: codes of further names, such as all courts of a circuit."""
    known = {a: r[5] for r in catalogue_rows() if r[5] for a in (*r[4], *r[2])} | {"tax court": "192", "court of claims": "188"} | (groups or {})

    def one(raw: Column) -> Column:
        name = court_name(raw)
        return F.coalesce(F.try_element_at(_table(known), name), F.try_element_at(_table(known), court_name(F.regexp_replace(name, r"\s+courts?$", ""))))

    codes = F.transform(F.filter(F.transform(F.split(spec, ","), lambda v: F.trim(v)), lambda v: v != ""), one)
    return F.when((F.size(codes) > 0) & F.forall(codes, lambda c: c.isNotNull()), F.array_join(codes, ","))


def court_ids(spec: Column, aliases: dict[str, str] | None = None) -> Column:
    """A comma list of CourtListener courts as an array of distinct ids; null if one can't be an id. aliases: names of further courts."""
    table = _table((aliases or {}) | {a: r[3][0] for r in catalogue_rows() if r[1] == "federal_court" for a in r[4]})
    clean = F.filter(F.transform(F.split(spec, ","), lambda v: F.regexp_replace(F.replace(F.trim(v), F.lit("."), F.lit("")), r"\s+", " ")), lambda v: v != "")
    ids = F.array_distinct(F.transform(clean, lambda v: F.coalesce(F.try_element_at(table, F.lower(v)), v)))
    return F.when(spec.isNull(), F.array().cast("array<string>")).when(F.forall(ids, lambda v: v.rlike("^[A-Za-z][A-Za-z0-9-]*$")), ids)
