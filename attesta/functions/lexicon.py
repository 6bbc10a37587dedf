"""Term lists and tests for them. All operators take their lists as parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A list for all rows, or a column of arrays of strings: a list for each row.
Terms = Iterable[str] | Column


def as_array(terms: Terms) -> Column:
    return terms if isinstance(terms, Column) else F.array(*map(F.lit, terms)).cast("array<string>")


def hits(text: Column, terms: Terms) -> Column:
    """How many of the distinct terms the text contains."""
    return F.size(F.filter(F.array_distinct(as_array(terms)), lambda t: F.contains(text, t)))


def any_of(text: Column, terms: Terms) -> Column:
    """Whether the text contains any of the terms; a row without a list has none."""
    return F.coalesce(F.exists(as_array(terms), lambda t: F.contains(text, t)), F.lit(False))


# The default term lists, in the language of the crawled sites.
NEGATIVE = ("質疑", "投訴", "爭議", "退款", "不透明", "疑慮", "違法", "虐待", "惡臭", "超收", "髒亂")
POSITIVE = ("改善", "澄清", "反駁", "良好", "整潔", "合格", "透明", "公開", "說明")
FIRST_HAND = ("實地", "參訪", "親自", "我看到", "我拍到", "現場", "親眼", "我去", "我們到場")
REPORTED = ("受訪", "表示", "指出", "說", "提到", "新聞資料", "報導", "訪談", "轉述", "引述")
HARD_EVIDENCE = ("照片", "影片", "裁罰", "公文", "公告", "判決", "稽查", "現場畫面", "檢舉")
HISTORY = ("2018", "2017", "道歉", "財務", "延遲", "透明", "爭議", "質疑", "募資", "flyingv")
FUNDRAISING = ("募資", "捐款", "善款", "勸募", "公益勸募", "財務", "透明", "經費", "款項", "flyingv")
CONTROVERSY = ("爭議", "質疑", "疑慮", "風波", "道歉", "聲明", "澄清")
EVIDENCE = ("聲明", "公告", "新聞", "報導", "facebook", "instagram", "threads", "dcard", "ptt", "google", "maps", "募資", "捐款", "公益勸募")
REVIEW = ("評論", "評價", "心得", "推薦", "不推", "好評", "負評", "留言", "reviews", "review", "star", "評分")
DOMAIN_QUERY = ("動保", "動保法", "動物福利", "虐待", "棄養", "飼養環境", "超收", "死亡", "照護", "非法繁殖", "收容", "救援", "絕育", "展演", "稽查", "裁罰")
DOMAIN = ("動物", "犬", "狗", "貓", "毛孩", "收容", "救援", "棄養", "虐待", "受傷", "死亡", "飼養", "籠養", "超收", "惡臭", "環境", "照護", "醫療", "絕育", "繁殖", "非法繁殖", "展演", "稽查", "裁罰", "動保", "動保法", "動物福利")
DOMAIN_STRONG = ("動保法", "動物福利", "虐待", "棄養", "非法繁殖", "超收", "稽查", "裁罰", "救援", "收容", "飼養環境")
DOMAIN_EXCLUDED = ("購物", "商城", "票務", "排隊", "候位", "演唱會", "活動", "娛樂", "明星", "八卦", "旅遊", "打卡", "美食", "展覽")
DOMAIN_NEGATED = ("與動物無關", "沒有提到動物", "沒有提到動保", "沒有提到動物照護", "沒有提到收容", "沒有提到飼養", "不涉及動保", "非動物相關")
RECENCY = ("最近", "近期", "最新", "今天", "本週", "本月", "近況", "最近有沒有")
AUTHORITATIVE_HOSTS = ("sasw.mohw.gov.tw", "mohw.gov.tw", ".gov.tw", ".gov", "dongwangwang.bobo.care", "flyingv.cc", "donate.newebpay.com")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "threads.net", "dcard.tw", "ptt.cc", "google.com", "maps.google.com")
TRUSTED_HOSTS = ("flyingv.cc", "sasw.mohw.gov.tw", "facebook.com", "ptt.cc", "dcard.tw", "threads.net", "instagram.com")
NO_SUMMARY = ("目前沒有可用的摘要內容", "目前沒有可用的相關段落", "no summary available")
LOGIN_PAGE = ("log into facebook", "sign up for facebook", "explore the things you love", "privacy policy", "messenger", "meta pay", "ray-ban meta", "create ad", "about create ad", "more languages", "mentions facebook", "paint0_linear", "paint1_ra", "userspaceonuse", "stop-color", "fill'url(%23", "error 403", "that’s an error", "播放影片", "current time 0:00", "stream type live", "skip navigation")
RANK_REVIEW = ("評論", "評價", "心得", "推薦", "不推", "好評", "負評", "留言", "星等", "評分", "review", "reviews")
RANK_HISTORY = ("2018", "2017", "道歉", "財務", "透明", "延遲", "聲明", "爭議", "質疑", "募資")
OWN_PAGES = ("dongwangwang.bobo.care", "newebpay.com")
NO_RESULTS = ("no results found", "the page you requested could not be found", "try refining your search", "select page", "use the navigation above to locate the")
NOISE = ("trycloudflare.com", "visibility-effects", "function(", "__next", "webpack", "javascript", "css", "paint0_linear", "paint1_ra", "userspaceonuse", "stop-color", "fill'url(%23", "mentions facebook", "文章列表", "精華區", "error 403", "that’s an error", "skip navigation", "current time 0:00", "stream type live", "no results found", "the page you requested could not be found", "try refining your search", "select page")
GRAY_TEXT = ("分類彙整", "文章列表", "標籤彙整", "搜尋結果", "站內搜尋", "上一篇", "下一篇", "related posts", "continue reading", "archive", "category", "tag archive", "search results", "no posts", "older posts")
GRAY_URL = ("/category/", "/tag/", "/search", "?s=", "/archives/", "/archive/", "/author/", "/page/")
QUESTION_WORDS = ("詐騙", "退款", "爭議", "動物", "福利", "募資", "透明", "環境", "評價")
