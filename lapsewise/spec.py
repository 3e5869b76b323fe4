"""The parameters of a retention study, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

from lapsewise.functions.months import key_index, key_plus

# Market codes, chain codes, report names and labels that appear
# in results.
ATTRIBUTE_MARKETS = (
    "31100", "32100", "31400", "64300", "41100", "23400", "31300", "20200", "72100",
)
LIST_MARKET = "39200"
LIST_MARKET_DESC = "DIABETES"
MARKET_RANKS = (
    ("31100", 1),
    ("31400", 2),
    ("39200", 3),
    ("64300", 4),
    ("32100", 5),
    ("72100", 6),
    ("41100", 7),
    ("23400", 8),
    ("31300", 9),
    ("20200", 10),
)
CHAIN_NAMES = (("032", "Supercenter"), ("955", "Neighborhood"))
NEW = "NEW"
CONTINUING = "CONTINUING"


@dataclass(frozen=True)
class Labels:
    """Texts of destinations, classes and the report; the defaults are fixed values as well."""

    mail: str = "Mail"
    competitor: str = "Competitor"
    stopped: str = "Stopped Treatment"
    not_lost: str = "not lost"
    attention: str = "ATTENTION"
    detail_off_grid: str = "Off Grid"
    detail_own: str = "Loss_WMT"
    detail_sister: str = "Loss_Sam"
    detail_mail: str = "Loss_Mail"
    detail_prefix: str = "Loss_"
    report_mail: str = "Lost to Mail"
    report_competitor: str = "Lost to Competitor"
    report_off_grid: str = "Off Grid"
    chain_unknown: str = "null"


@dataclass(frozen=True)
class RetentionSpec:
    """Months are integers YYYYMM; spans are counted in whole months.

    The defaults are fixed values too: those of the study the labels belong to.
    """

    cohort_first: int = 201501
    cohort_last: int = 201512
    lookback_months: int = 12
    span_months: int = 18
    gap_months: int = 7
    min_fills: int = 2

    cohort_chains: tuple[str, ...] = ("032", "955")
    sister_chain: str = "033"
    cohort_channels: tuple[str, ...] = ("RETAIL",)
    mail_channel: str = "MAIL"
    retail_channel: str = "RETAIL"
    excluded_suppliers: tuple[int, ...] = (725,)
    excluded_states: tuple[str, ...] = ("VI", "PR")
    own_mail_supplier: int = 348

    long_fill_days: int = 84
    long_fill_weight: int = 3

    attribute_markets: tuple[str, ...] = ATTRIBUTE_MARKETS
    special_flag: str = "9"
    list_market: str = LIST_MARKET
    list_market_desc: str = LIST_MARKET_DESC
    code_length: int = 12
    exclusion_market: str = LIST_MARKET
    outlet_class_mail: str = "OTHER"

    #: Markets must be unambiguous; otherwise a product described twice counts twice.
    strict_market: bool = True

    labels: Labels = Labels()
    market_ranks: tuple[tuple[str, int], ...] = MARKET_RANKS
    chain_names: tuple[tuple[str, str], ...] = CHAIN_NAMES

    def __post_init__(self) -> None:
        if self.cohort_last < self.cohort_first:
            raise ValueError("cohort_last lies before cohort_first")
        if not 1 < self.gap_months <= self.span_months:
            raise ValueError("gap_months must be 2..span_months")
        if self.lookback_months < 1 or self.min_fills < 1:
            raise ValueError("lookback_months and min_fills must be at least 1")

    @property
    def followup_channels(self) -> tuple[str, ...]:
        return (self.retail_channel, self.mail_channel)

    @property
    def cohort_count(self) -> int:
        return key_index(self.cohort_last) - key_index(self.cohort_first) + 1

    @property
    def lookback_first(self) -> int:
        return key_plus(self.cohort_first, -self.lookback_months)

    @property
    def lookback_last(self) -> int:
        return key_plus(self.cohort_last, -1)

    @property
    def fills_last(self) -> int:
        """Last month any cohort looks at."""
        return key_plus(self.cohort_last, self.span_months - 1)

    @property
    def last_lost_month(self) -> int:
        """Largest month number in which a loss can begin."""
        return self.span_months - self.gap_months + 1

    @property
    def never_lost(self) -> int:
        return self.last_lost_month + 1
