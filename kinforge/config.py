"""Settings of the linkage engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: results depend on them -----------------------------------------------------------------------
NAME_STOPWORDS = (
    "the and of in for on at to a an by with "
    "co inc ltd corp llc company corporation limited "
    "services solutions enterprises group associates "
    "pvt shree sri om india private trading "
    "de la le les et du des en au aux pour "
    "sarl sas sa france societe"
).split()

ADDRESS_STOPWORDS = (
    "road street avenue drive lane boulevard highway court "
    "suite apartment unit floor near opposite infront behind "
    "colony nagar village town district city state door no "
    "rue allee chemin place impasse france india delhi ny ca "
    "tx fl il pa oh ga nc mi nj va wa az ma"
).split()

SKELETON_STOPWORDS = "prvt prvat pvt lmtd ltd lmted prat pra li llp kmpn kompn ind indstrs limitd".split()

LEGAL_FORMS = (
    r"pvt\s*ltd", r"private\s*limited", "pvt", "private", "ltd", "limited", "llp",
    "inc", "incorporated", "corp", "corporation", "llc", "co", "company",
    "sarl", "sasu", "sas", "sa", "eurl", "eirl", "sci", "snc", "scop", "gie", "cie",
)

STREET_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "ste": "suite", "apt": "apartment", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "ter": "terrace", "sq": "square",
    "r": "rue", "bd": "boulevard", "bvd": "boulevard", "av": "avenue", "all": "allee", "imp": "impasse", "pl": "place",
    "che": "chemin", "rte": "route", "fg": "faubourg",
}

KEY_WEIGHTS = {"tok": 2.0, "num": 4.0, "zip": 3.0, "bg": 5.0, "tp": 3.0, "sk": 4.0}
# ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LinkConfig:
    """Settings of one linkage run.

    A key held by more than ``posting_cap`` candidates is no evidence and is dropped as a whole: that is part of the
    result's definition, and it also keeps every join key's fan-out bounded.
    """

    posting_cap: int = 150
    name_matches: int = 30
    rerank_pool: int = 300
    max_candidates: int = 35
    skeleton_countries: tuple[str, ...] = ("India",)
    address_pairs: int = 2
    exact_weight: float = 20.0
    compressed_weight: float = 15.0
    confidence_floor: float = 0.70
    band: tuple[float, float] = (0.20, 0.88)
    screener_share: float = 0.7
    probability_decimals: int = 6
    keep_duplicate_keys: bool = False
    persist: bool = True  # keep the tables that several operators read (memory, then disk); see Linkage.release
    cut: bool = False  # compute these at once and cut their lineage, so that the driver holds and plans small plans
    key_weights: dict = field(default_factory=lambda: dict(KEY_WEIGHTS))
