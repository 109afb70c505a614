"""Region names to state codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.functions.text import strip

# State name, letters only, to two-letter code.
STATE_CODES = {
    "AndhraPradesh": "AP",
    "ArunachalPradesh": "AR",
    "Assam": "AS",
    "Bihar": "BR",
    "Chhattisgarh": "CG",
    "Goa": "GA",
    "Gujarat": "GJ",
    "Haryana": "HR",
    "HimachalPradesh": "HP",
    "JammuAndKashmir": "JK",
    "Jharkhand": "JH",
    "Karnataka": "KA",
    "Kerala": "KL",
    "MadhyaPradesh": "MP",
    "Maharashtra": "MH",
    "Manipur": "MN",
    "Meghalaya": "ML",
    "Mizoram": "MZ",
    "Nagaland": "NL",
    "Odisha": "OR",
    "Punjab": "PB",
    "Rajasthan": "RJ",
    "Sikkim": "SK",
    "TamilNadu": "TN",
    "Telangana": "TG",
    "Tripura": "TR",
    "UttarPradesh": "UP",
    "Uttarakhand": "UK",
    "WestBengal": "WB",
    "AndamanAndNicobarIslands": "AN",
    "Chandigarh": "CH",
    "DadraAndNagarHaveliAndDamanAndDiu": "DN",
    "Delhi": "DL",
    "Lakshadweep": "LD",
    "Puducherry": "PY",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def state_code(c: Column, *, reference_case: bool = False) -> Column:
    """Two letters count as a code; otherwise the letters of the name are looked up.

    An unknown name yields its own letters in title case. By default the lookup ignores case.
    ``reference_case=True`` looks up the title-cased letters, so that names of several words
    are never found.
    """
    raw = strip(c.cast("string"))
    title = F.initcap(F.regexp_replace(raw, "[^A-Za-z]", ""))
    if reference_case:
        code = F.try_element_at(_map(STATE_CODES), title)
    else:
        code = F.try_element_at(_map({k.lower(): v for k, v in STATE_CODES.items()}), F.lower(title))
    return F.when(raw.rlike(r"^\p{L}{2}$"), F.upper(raw)).otherwise(F.coalesce(code, title))
