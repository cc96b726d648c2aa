"""Rule-based extraction and gates over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import matches

# Error codes, matched in any case.
ERROR_CODES = (
    r"GAUSS-\d{5}", r"ORA-\d{5}", r"PG-\d{4,5}", r"MYSQL-\d{4}", r"SQL-\d{4,5}", r"ERROR\s+\d{4,5}", r"ERR-\w+-\d+", r"ERRCODE\s+\w+", r"ErrorCode:\s*\d+", r"E\d{3,5}",
)
# Log phrases, matched in any case.
LOG_PHRASES = (
    r"connection\s+refused", r"connection\s+failed", r"connection\s+timeout", r"connection\s+reset", r"could\s+not\s+connect", r"failed\s+to\s+connect", r"unable\s+to\s+connect",
    r"timeout|timed\s+out", r"request\s+timeout",
    r"permission\s+denied", r"access\s+denied", r"authentication\s+failed", r"auth\s+error", r"login\s+failed", r"invalid\s+credentials", r"password\s+incorrect",
    r"out\s+of\s+memory", r"memory\s+allocation\s+failed", r"disk\s+full", r"no\s+space\s+left", r"storage\s+full", r"resource\s+unavailable", r"insufficient\s+resources",
    r"network\s+error", r"network\s+unreachable", r"host\s+unreachable", r"no\s+route\s+to\s+host", r"socket\s+error", r"port\s+already\s+in\s+use",
    r"data\s+corruption", r"invalid\s+data", r"data\s+format\s+error", r"parse\s+error", r"syntax\s+error", r"encoding\s+error",
    r"process\s+terminated", r"process\s+killed", r"process\s+died", r"child\s+process\s+failed", r"fork\s+failed",
    r"config\s+error", r"configuration\s+invalid", r"invalid\s+parameter", r"missing\s+config", r"config\s+file\s+not\s+found",
    r"failed\s+to\s+\w+", r"error\s+in\s+\w+", r"exception\s+\w+", r"fatal\s+error", r"critical\s+error",
)
# Names and versions of the environment, by category, matched in any case.
ENVIRONMENT = {
    "database": (r"(PostgreSQL|postgres)\s+(\d+\.\d+(?:\.\d+)?)", r"(Oracle)\s+(\d+[cRg]?(?:\.\d+)?)", r"(MySQL)\s+(\d+\.\d+(?:\.\d+)?)", r"(GaussDB|gaussdb)\s+(\d+\.\d+(?:\.\d+)?)", r"(SQLServer|sqlserver)\s+(\d+)", r"(MongoDB|mongodb)\s+(\d+\.\d+(?:\.\d+)?)"),
    "os": (r"(Linux)\s+(\d+\.\d+(?:\.\d+)?)", r"(CentOS|centos)\s+(\d+)", r"(Ubuntu|ubuntu)\s+(\d+\.\d+)", r"(RedHat|RHEL|rhel)\s+(\d+)", r"(Windows)\s+(\d+)", r"(SUSE|suse)\s+(\d+)"),
    "middleware": (r"(Tomcat|tomcat)\s+(\d+\.\d+(?:\.\d+)?)", r"(Nginx|nginx)\s+(\d+\.\d+(?:\.\d+)?)", r"(Apache|apache)\s+(\d+\.\d+(?:\.\d+)?)", r"(Redis|redis)\s+(\d+\.\d+(?:\.\d+)?)", r"(Kafka|kafka)\s+(\d+\.\d+(?:\.\d+)?)"),
}
# Service components, found anywhere in a text.
SERVICES = (
    "gaussdb", "gausskernel", "gsql", "gs_ctl", "gs_dump", "gs_restore", "postgres", "postgresql", "mysql", "oracle", "sqlserver", "om", "gs_om", "etcd", "cms", "gtm", "cm_agent", "cm_server",
    "tomcat", "nginx", "apache", "redis", "kafka", "zookeeper", "memcached", "systemd", "crond", "sshd", "networkd", "logrotate", "supervisord",
)
# Words of each class of problem.
PROBLEMS = {
    "性能问题": ("慢查询", "性能下降", "响应慢", "高延迟", "吞吐量低", "卡顿", "hang", "slow", "performance", "瓶颈"),
    "连接问题": ("连接失败", "无法连接", "连接超时", "断连", "掉线", "connection", "网络", "端口", "socket"),
    "数据问题": ("数据丢失", "数据不一致", "数据损坏", "数据错误", "corruption", "inconsistency", "data loss"),
    "权限问题": ("权限不足", "拒绝访问", "认证失败", "登录失败", "permission", "access denied", "authentication"),
    "配置问题": ("配置错误", "参数错误", "设置不当", "配置冲突", "config", "parameter", "setting"),
    "资源问题": ("内存不足", "磁盘满", "空间不足", "资源耗尽", "memory", "disk", "space", "resource"),
    "集群问题": ("集群故障", "节点宕机", "主备切换", "脑裂", "cluster", "node", "failover", "split-brain"),
    "备份恢复": ("备份失败", "恢复失败", "数据导出", "数据导入", "backup", "restore", "dump", "import"),
}
# Phrases of explicit references to earlier turns.
REFERENCES = (
    r"基于上(面|述|文)", r"根据(刚才|之前|上文)", r"继续(讨论|说明|解释)", r"那个(问题|文档|概念)", r"它(是指|是什么|怎么样)", r"关于(这|那)(个|些)", r"进一步", r"还有(什么|哪些)", r"(更多|更详细)(的|地)?",
)
# Metadata that is not stored, and the largest value that is.
LARGE_KEYS = ("image_map", "b64_image", "image_data", "original_image", "combined_text", "_document", "page_content", "b64_json", "base64", "embeddings", "text_vector", "content_vector", "chunk_images")
LARGE_VALUE = 50 * 1024


def error_codes(text: Column) -> Column:
    """Sorted error codes; five digits by themselves count too. Codes with a hyphen, or of letters, in upper case."""
    found = F.flatten(F.array(*[matches(text, f"(?i){p}") for p in ERROR_CODES], F.filter(matches(text, r"[0-9A-Za-z_]+"), lambda x: x.rlike(r"^\d{5}$"))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.when(F.contains(x, F.lit("-")) | x.rlike(r"^[A-Za-z]+$"), F.upper(x)).otherwise(x))))


def log_phrases(text: Column) -> Column:
    """Sorted log phrases in lower case. One pass tells whether there are any; only then each is looked for by itself."""
    some = text.rlike("(?i)" + "|".join(LOG_PHRASES))
    return F.when(~some, F.array().cast("array<string>")).otherwise(_log_phrases(text))


def _log_phrases(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform(matches(text, f"(?i){p}"), F.lower) for p in LOG_PHRASES]))))


def services(text: Column) -> Column:
    low = F.lower(text)
    return F.array_sort(F.filter(F.array(*map(F.lit, SERVICES)), lambda p: F.contains(low, p)))


def problem_words(text: Column) -> Column:
    """Sorted words of all classes in the text, and the names of those classes."""
    low = F.lower(text)
    parts = []
    for name, words in PROBLEMS.items():
        hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w)))
        parts.append(F.when(F.size(hits) > 0, F.concat(F.array(F.lit(name)), hits)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def environment(text: Column) -> Column:
    """Entries (key, value): the first match of each name and of each category, in the order of the patterns."""
    entries = []
    for category, patterns in ENVIRONMENT.items():
        every = []
        for p in patterns:
            name, version = F.regexp_extract(text, f"(?i){p}", 1), F.regexp_extract(text, f"(?i){p}", 2)
            hit = F.when(name != "", F.concat_ws(" ", name, version))
            every.append(hit)
            entries.append(F.struct(F.concat(F.lit(f"{category}_"), F.lower(name)).alias("key"), hit.alias("value")))
        entries.append(F.struct(F.lit(category).alias("key"), F.coalesce(*every).alias("value")))
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def asks_back(text: Column) -> Column:
    """Whether a question refers to what was said before."""
    return text.rlike("|".join(f"(?:{p})" for p in REFERENCES))


def stored_metadata(entries: Column) -> Column:
    """A map without large keys, whatever their case, and without large values."""
    return F.map_filter(entries, lambda k, v: ~F.lower(k).isin(*LARGE_KEYS) & (F.length(v) <= LARGE_VALUE))


def last_score(text: Column) -> Column:
    """The last number of a text, held between 0 and 1; 0.5 without one."""
    found = matches(text, r"[0-9]*\.?[0-9]+")
    return F.coalesce(F.least(F.greatest(F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(-1)).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def parsed_variants(text: Column, n: int = 3) -> Column:
    """Query variants of a model's answer: lines without lead-ins and numbers, the first n."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(Query|Alternative|Version|-)"))
    return F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\d[.: ] ?", ""))), 1, n)
