"""Parameters of one feature run.

Training and scoring use the same functions; only a `FeatureConfig` differs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class Vocabulary:
    """Words the source tables use for the values the features depend on."""

    vacation: str
    single: str
    ticket_product: str
    single_search_words: tuple[str, ...]
    connected: str
    inbound: str
    sex_name: str
    age_name: str
    age_group_name: str
    phone_name: str
    city_name: str
    vacation_words: tuple[str, ...]
    single_words: tuple[str, ...]
    active_service_word: str
    sex_codes: dict[str, int] = field(hash=False)
    age_group_codes: dict[str, int] = field(hash=False)
    channels: tuple[str, str, str, str]


# The words found in the travel warehouse tables.
WAREHOUSE_WORDS = Vocabulary(
    vacation="度假产品",
    single="单资源产品",
    ticket_product="门票",
    single_search_words=("票", "酒店"),
    connected="通话",
    inbound="呼入",
    sex_name="性别",
    age_name="年龄",
    age_group_name="年龄段",
    phone_name="手机号",
    city_name="所在城市",
    vacation_words=("商旅", "跟团", "自驾", "自助", "目的地服务", "签证", "团队", "定制", "游轮", "旅拍", "游", "团"),
    single_words=("火车票", "机票", "酒店", "百货", "用车服务", "高铁", "票", "硬座", "软卧", "卧铺", "航班"),
    active_service_word="客人发送消息",
    sex_codes={"男": 1, "女": 0},
    age_group_codes={"0~15岁": 1, "16~25岁": 2, "26~35岁": 3, "36~45岁": 4, "大于46岁": 5},
    channels=("电话呼入呼出", "智能外呼", "企微聊天", "在线客服"),
)

# The words of the stand-in views on the test tables.
STANDIN_WORDS = Vocabulary(
    vacation="VACATION",
    single="SINGLE",
    ticket_product="TICKET",
    single_search_words=("ticket", "hotel"),
    connected="TALK",
    inbound="IN",
    sex_name="SEX",
    age_name="AGE",
    age_group_name="AGE_GROUP",
    phone_name="PHONE",
    city_name="CITY",
    vacation_words=("and", "ing"),
    single_words=("the", "tion"),
    active_service_word="en",
    sex_codes={"M": 1, "F": 0},
    age_group_codes={"0-15": 1, "16-25": 2, "26-35": 3, "36-45": 4, "46+": 5},
    channels=("call", "robot", "wecom", "service"),
)


@dataclass(frozen=True)
class FeatureConfig:
    """One cohort: its windows, order bounds and vocabulary.

    `anchor` is None for the last-activity anchor, or a date shared by the cohort.
    An order bound of None reads the whole order history.
    """

    words: Vocabulary
    activity_start: date
    activity_end: date
    behavior_start: date
    behavior_end: date
    anchor: date | None = None
    label_orders_since: date | None = None
    history_orders_since: date | None = None
    call_orders_since: date | None = None
    interval_orders_since: date | None = None
    id_range: tuple[int, int] = (1, 1000000001)
    # Sales channels of orders that count, and labels of robot calls that show an intent.
    distribution_flags: tuple[int, ...] = (0, 3, 4, 5)
    intent_labels: tuple[str, ...] = ("a", "b", "q", "c", "p", "s")
    label_horizons: tuple[int, ...] = (7, 15)
    history_days: int = 60
    lookback_days: int = 15
    decision_cap: int = 16
    phone_digits: int = 11
    # One class for a route with several: the alphabetically last. By default each class joins.
    one_class_per_route: bool = False
    # True: a customer with several values of an attribute has a row for each in the profile, as in the source's joins.
    every_attribute_value: bool = False
    # False: of several ratings with the newest time only one counts.
    rating_ties: bool = True

    @property
    def anchors(self) -> tuple[date, date]:
        """The first and the last day an anchor can be."""
        return (self.anchor, self.anchor) if self.anchor else (self.activity_start, self.activity_end)


def training_config() -> FeatureConfig:
    """Training cohort on the test tables: July 1998, anchor is the last activity."""
    start = date(1998, 7, 1)
    return FeatureConfig(
        words=STANDIN_WORDS,
        activity_start=start,
        activity_end=date(1998, 7, 24),
        behavior_start=start,
        behavior_end=date(1998, 7, 24),
        label_orders_since=start,
        history_orders_since=start - timedelta(days=59),
        call_orders_since=date(1998, 6, 1),
    )


def scoring_config() -> FeatureConfig:
    """Scoring cohort on the test tables: one day.

    The behaviour window starts 16 days before the anchor, so that "touched before the
    trailing 15 days" can occur when scoring exactly as it can when training.
    """
    day = date(1998, 7, 28)
    return FeatureConfig(
        words=STANDIN_WORDS,
        activity_start=day,
        activity_end=day,
        behavior_start=day - timedelta(days=16),
        behavior_end=day,
        anchor=day,
        label_orders_since=day + timedelta(days=1),
        history_orders_since=day - timedelta(days=59),
        call_orders_since=day - timedelta(days=32),
    )
