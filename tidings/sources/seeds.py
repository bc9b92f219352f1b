"""Seed rows of the dimensions (S-11): three sector lists, three source lists,
two configuration lists, one per variant of the original system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the original system's for equal results.
# ---------------------------------------------------------------------------
# code, name, keywords, weight, parent code
SECTORS = [
    ("tech", "科技", ["科技", "技术", "AI", "人工智能", "芯片", "互联网", "软件", "硬件"], "1.00", None),
    ("finance", "金融", ["金融", "银行", "保险", "投资", "股市", "证券", "基金", "理财"], "1.00", None),
    ("consumer", "消费", ["消费", "零售", "电商", "品牌", "购物", "餐饮", "旅游"], "0.90", None),
    ("healthcare", "医疗", ["医疗", "医药", "健康", "生物科技", "疫苗", "医院"], "0.95", None),
    ("new_energy", "新能源", ["新能源", "电动车", "光伏", "储能", "电池", "风电", "氢能"], "0.85", None),
    ("real_estate", "房地产", ["房地产", "楼市", "房价", "地产", "建筑", "物业"], "0.80", None),
    ("manufacturing", "制造业", ["制造", "工厂", "生产", "供应链", "工业", "自动化"], "0.85", None),
    ("ai", "人工智能", ["AI", "人工智能", "大模型", "机器学习", "深度学习", "算法"], "0.95", "tech"),
    ("semiconductor", "半导体", ["芯片", "半导体", "晶圆", "代工", "光刻", "集成电路"], "0.90", "tech"),
]
SIMPLE_SECTORS = [
    ("sw_1_agriculture", "农林牧渔", ["农业", "种植", "养殖", "渔业", "林业", "农产品"]),
    ("sw_1_mining", "基础化工", ["化工", "化学", "材料", "能源"]),
    ("sw_1_steel", "钢铁", ["钢铁", "冶金", "金属"]),
    ("sw_1_electronics", "电子", ["电子", "芯片", "半导体", "集成电路", "硬件"]),
    ("sw_1_computer", "计算机", ["计算机", "软件", "IT", "科技", "互联网"]),
    ("sw_1_media", "传媒", ["传媒", "媒体", "广告", "影视", "游戏", "娱乐"]),
    ("sw_1_telecom", "通信", ["通信", "5G", "电信", "网络", "通讯"]),
    ("sw_1_new_energy", "电力设备", ["新能源", "电力", "光伏", "风电", "储能", "电池"]),
    ("sw_1_auto", "汽车", ["汽车", "新能源", "电动车", "造车", "自动驾驶"]),
    ("sw_1_medicine", "医药生物", ["医药", "医疗", "药品", "生物", "健康", "疫苗"]),
    ("sw_1_retail", "商贸零售", ["零售", "电商", "消费", "购物", "超市"]),
    ("sw_1_estate", "房地产", ["房地产", "楼市", "房价", "地产", "物业"]),
    ("sw_1_bank", "银行", ["银行", "金融", "贷款", "存款", "利率"]),
    ("sw_1_securities", "非银金融", ["证券", "保险", "基金", "投资", "理财"]),
    ("sw_1_machinery", "机械设备", ["机械", "设备", "制造", "工业", "自动化"]),
    ("sw_1_defense", "国防军工", ["军工", "国防", "航空", "航天", "装备"]),
    ("sw_1_construction", "建筑装饰", ["建筑", "装饰", "工程", "基建", "房地产"]),
    ("sw_1_transport", "交通运输", ["交通", "运输", "物流", "航空", "航运", "快递"]),
    ("sw_1_consumer", "食品饮料", ["食品", "饮料", "消费", "白酒", "零售"]),
    ("sw_1_textile", "纺织服饰", ["纺织", "服装", "服饰", "面料", "时尚"]),
]
# name, url, fetch interval in seconds
SOURCES = [
    ("36氪", "https://36kr.com/feed", 300),
    ("财新网", "https://weekly.caixin.com/rss.xml", 600),
    ("华尔街见闻", "https://wallstreetcn.com/rss.xml", 300),
    ("澎湃新闻", "https://www.thepaper.cn/rss.xml", 600),
    ("界面新闻", "https://www.jiemian.com/rss.xml", 600),
]
SIMPLE_SOURCES = [
    ("36氪", "https://36kr.com/feed"),
    ("财新", "https://feed.caixin.com/rss.xml"),
]
MINIMAL_SOURCES = [
    ("36氪", "https://36kr.com/feed"),
    ("IT之家", "https://www.ithome.com/rss"),
    ("Solidot", "https://www.solidot.org/index.rss"),
    ("TechCrunch", "https://techcrunch.com/feed/"),
    ("Ars Technica", "http://feeds.arstechnica.com/arstechnica/index"),
    ("The Verge", "https://www.theverge.com/rss/index.xml"),
]
# key, value, type
CONFIGS = [
    ("collector_interval_sec", "300", "integer"),
    ("sentiment_batch_size", "10", "integer"),
    ("sentiment_max_retries", "3", "integer"),
    ("aggregation_window_hours", "24", "integer"),
    ("aggregation_interval_minutes", "60", "integer"),
    ("data_retention_days", "90", "integer"),
    ("aggregated_data_retention_days", "365", "integer"),
    ("log_retention_days", "30", "integer"),
    ("daily_report_time", "08:00", "string"),
    ("cleanup_schedule", "0 2 * * *", "string"),
    ("enable_auto_cleanup", "true", "boolean"),
    ("enable_sentiment_alert", "false", "boolean"),
    ("sentiment_alert_threshold", "0.8", "float"),
    ("api_rate_limit", "1000", "integer"),
    ("api_cache_ttl", "300", "integer"),
]
SIMPLE_CONFIGS = [
    ("data_retention_days", "90"),
    ("sentiment_threshold_positive", "0.3"),
    ("sentiment_threshold_negative", "-0.3"),
    ("collection_interval", "300"),
]
# the minimal variant's sectors are operators.sectors.SEED_SECTORS


def json_list(words) -> str:
    return "[" + ", ".join(f'"{w}"' for w in words) + "]"


def seed_sectors(spark: SparkSession) -> DataFrame:
    """(variant, code, name, keywords as JSON text, weight, parent_code)."""
    from ..operators.sectors import SEED_SECTORS

    rows = [("full", c, n, json_list(k), w, p) for c, n, k, w, p in SECTORS]
    rows += [("simple", c, n, json_list(k), None, None) for c, n, k in SIMPLE_SECTORS]
    rows += [("minimal", c, n, json_list(k), None, None) for c, n, k in SEED_SECTORS]
    x = spark.createDataFrame(rows, "variant string, code string, name string, keywords string, weight string, parent_code string")
    return x.withColumn("weight", F.col("weight").cast("decimal(3,2)"))


def seed_sources(spark: SparkSession) -> DataFrame:
    """(variant, name, url, type, fetch_interval); all are active RSS feeds."""
    rows = [("full", n, u, i) for n, u, i in SOURCES]
    rows += [(v, n, u, 300) for v, lst in (("simple", SIMPLE_SOURCES), ("minimal", MINIMAL_SOURCES)) for n, u in lst]
    x = spark.createDataFrame(rows, "variant string, name string, url string, fetch_interval int")
    return x.select("variant", "name", "url", F.lit("rss").alias("type"), "fetch_interval")


def seed_configs(spark: SparkSession, variant: str = "full") -> DataFrame:
    """(config_key, config_value, value_type) of one variant."""
    rows = CONFIGS if variant == "full" else [(k, v, "string") for k, v in SIMPLE_CONFIGS]
    return spark.createDataFrame(rows, "config_key string, config_value string, value_type string")
