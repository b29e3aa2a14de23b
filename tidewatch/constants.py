"""Word lists, bounds, patterns and texts that results depend on."""

# --- fixed values: severity bounds (seconds, rows) ---
P0_SECONDS = 10.0
P0_ROWS = 1_000_000
P1_SECONDS = 2.0
P1_ROWS = 100_000

# --- fixed values: label and mark of each grade ---
SEVERITY_LABELS = {"P0": "严重", "P1": "警告", "P2": "关注"}
SEVERITY_MARKS = {"P0": "🔴", "P1": "🟡", "P2": "🟢"}

# --- fixed values: schemas whose statements are never analysed ---
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys")

# --- fixed values: noise filter ---
NOISE_MIN_LENGTH = 10
NOISE_PREFIXES = (
    "SET ", "SHOW ", "QUIT", "CONNECT", "ADMIN", "XA ", "PING", "INIT DB", "BEGIN", "COMMIT", "ROLLBACK",
)
NOISE_FRAGMENTS = (
    "SELECT @@", "SELECT 1", "SELECT DATABASE()", "SELECT VERSION()", "SELECT CONNECTION_ID()",
    "SELECT SLEEP(", "SELECT COUNT(*) FROM SLOW_LOG", "SHOW VARIABLES", "SHOW GLOBAL STATUS",
    "INFORMATION_SCHEMA", "MYSQL.", "PERFORMANCE_SCHEMA",
    "DIAGNOSIS_RECORD", "CAPTURED_SQL", "RAG_DOCUMENT",
)
KEPT_PREFIXES = ("SELECT", "WITH", "EXPLAIN", "DESCRIBE")

# --- fixed values: statement-history filter (LIKE patterns) ---
HISTORY_EXCLUDED_LIKE = ("SET %", "SHOW %", "SELECT @@%", "%ApplicationName%")

# --- fixed values: words that make a statement a write ---
WRITE_WORDS = ("update", "delete", "drop", "insert", "truncate", "alter")

# --- fixed values: server variables that may be read ---
KNOWN_VARIABLES = (
    "innodb_buffer_pool_size", "max_connections", "thread_cache_size", "query_cache_size",
    "tmp_table_size", "max_heap_table_size", "sort_buffer_size", "join_buffer_size",
)

# --- fixed values: column names whose literals are masked ---
SENSITIVE_NAMES = (
    "phone", "mobile", "telephone", "tel",
    "id_card", "idcard", "id_no", "idno",
    "password", "pwd", "passwd", "secret",
    "email", "mail",
    "bank", "bank_card", "card_no", "cardno",
    "ssn", "social_security",
)

# --- fixed values: parameter types written with quotes in a bound statement ---
QUOTED_TYPES = ("string", "char", "timestamp", "date", "time")

# --- fixed values: knowledge base ---
CATEGORY_PRIORITY = {"军规": 1, "事故复盘": 2, "业务规则": 3}
OTHER_PRIORITY = 99
DEFAULT_CATEGORY = "业务规则"
SQL_KEYWORDS = ("JOIN", "LEFT JOIN", "ORDER BY", "GROUP BY", "LIMIT", "DISTINCT", "UNION", "HAVING")

# --- fixed values: texts ---
KNOWLEDGE_HEADER = "【企业知识库匹配规则】\n"
CONTEXT_HEADER = "【自动采集信息】\n"
STATEMENT_HEADER = "【待分析SQL】\n"
MANUAL_INSTRUCTION = "请按需调用工具获取DDL和执行计划进行诊断。"
RETRY_HEADER = "【重试诊断】\n【原始SQL】\n"
STALE_MESSAGE = "诊断超时（Agent可能异常退出）"
FAILED_PREFIX = "诊断失败: "
UNKNOWN_ERROR = "未知错误"
NEW_STATEMENT = "新发现慢查询"
ALERT_TITLE = "慢查询告警"
CACHED_REPORT = "已有诊断(缓存):\n"
MULTI_STATEMENT = "安全拦截：禁止执行多条拼接的 SQL 语句"
NOT_A_SELECT = "安全拦截：系统仅支持 SELECT 查询语句的分析，禁止包含 DML/DDL 等写操作"
EMPTY_STATEMENT = "安全拦截：SQL 不能为空"

# --- fixed values: tool labels shown in progress steps ---
TOOL_LABELS = {
    "get_table_ddl": "获取表结构", "get_execution_plan": "执行计划分析",
    "get_table_statistics": "表统计信息", "check_active_locks": "锁检查",
    "get_innodb_status": "InnoDB状态", "get_global_variable": "全局变量",
    "check_redundant_indexes": "冗余索引", "compare_execution_plan": "计划对比",
    "get_slow_log_stats": "慢日志统计", "check_missing_indexes": "缺失索引",
    "check_type_mismatch": "类型转换", "get_buffer_pool_hit_rate": "缓存命中率",
    "get_process_list": "连接列表", "check_actual_row_count": "实际行数",
}

# --- fixed values: rule set (id, category, title, conditions, suggestion) ---
RULES = (
    ("E001", "军规", "禁止 SELECT *",
     (("sql_contains", "SELECT *"),),
     "指定需要的列名，减少数据传输和回表开销"),
    ("E002", "军规", "WHERE 条件列禁止函数包裹",
     (("sql_pattern", r"WHERE.*(DATE\(|YEAR\(|MONTH\(|DATE_FORMAT\()"),),
     "函数包裹索引列导致索引失效，改用范围查询（BETWEEN 或 >= <=）"),
    ("E003", "军规", "禁止前置模糊匹配",
     (("sql_contains", "LIKE '%"),),
     "前置 % 无法使用索引，考虑全文索引或 Elasticsearch"),
    ("E004", "军规", "禁止 ORDER BY RAND()",
     (("sql_contains", "ORDER BY RAND()"),),
     "ORDER BY RAND() 导致全表排序，改用应用层随机或 TABLESAMPLE"),
    ("E005", "军规", "禁止大偏移量分页",
     (("sql_pattern", r"LIMIT\s+\d{5,}"),),
     "大偏移量分页性能极差，改用游标分页（WHERE id > last_id LIMIT n）"),
    ("E101", "优化", "缺索引-全表扫描",
     (("explain_access_type", "ALL"), ("explain_rows", "> 1000")),
     "type=ALL 全表扫描且扫描行数 > 1000，为 WHERE/JOIN 条件列创建索引"),
    ("E102", "优化", "隐式类型转换",
     (("explain_key_is_null", "true"), ("sql_pattern", r"WHERE\s+\w+\s*=\s*'\d+'")),
     "列类型与字符串比较值不匹配导致索引失效，确保类型一致"),
    ("E103", "优化", "文件排序-缺排序索引",
     (("explain_extra_contains", "Using filesort"),),
     "ORDER BY 列缺少索引导致文件排序，为排序列创建索引"),
    ("E104", "优化", "临时表-缺分组索引",
     (("explain_extra_contains", "Using temporary"),),
     "GROUP BY/DISTINCT 导致临时表，为分组列创建索引"),
    ("E105", "优化", "回表过多-缺覆盖索引",
     (("explain_filtered", "< 20.0"),),
     "filtered < 20% 说明大量回表过滤，考虑创建覆盖索引包含 SELECT 列"),
    ("E106", "优化", "JOIN 无索引",
     (("explain_access_type", "ALL"), ("sql_contains", "JOIN")),
     "JOIN 列缺少索引导致全表扫描，为 JOIN ON 条件列创建索引"),
    ("E107", "优化", "疑似笛卡尔积",
     (("sql_contains", "CROSS JOIN"),),
     "CROSS JOIN 产生笛卡尔积，确认是否需要关联条件，或缩小驱动表数据量"),
    ("E201", "事故复盘", "大事务风险",
     (("sql_contains", "DELETE"), ("explain_rows", "> 5000")),
     "单次 DELETE > 5000 行可能锁表，考虑分批删除（LIMIT + 循环）"),
    ("E202", "事故复盘", "UPDATE 无 WHERE 风险",
     (("sql_contains", "UPDATE"), ("sql_not_contains", "WHERE")),
     "UPDATE 无 WHERE 条件会更新全表，确认是否遗漏条件"),
)
