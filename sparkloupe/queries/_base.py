"""How queries are registered, and the source text that both engines make from the relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Bytes for each core below which a table is dealt out: its files may be a single row group, which is a single task.
SMALL = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if it is small; larger ones stay as they are split, without a shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if (1 << 20) < size < cores * SMALL else rows


#: One function of eight to ten lines for each order line; the same text in both engines. {rows} makes k from 1 to 10.
_PROC = """
select l_orderkey as file_id, cast(before + k as bigint) as line_no, cast(ln as bigint) as ln, case when k = n then '}}' when k > 7 then '    cnt = cnt + 1;' else case k
    when 1 then 'static int fn_' || ln || '(int a, char *src)'
    when 2 then '{{'
    when 3 then case l_partkey % 9 when 0 then '    int cnt;' when 1 then '    char buf[32]; /* strcpy(a, b) */' when 2 then '    strcpy(buf, src);'
        when 3 then '    ptr = malloc(n);' when 4 then '    memset(&l_rec, 0, sizeof(row_t));' when 5 then '    sprintf(buf, "%s strcat(x)", src); // gets(y)'
        when 6 then '    EXEC SQL FETCH cur_' || (l_suppkey % 3) || ' INTO :v1;' when 7 then '    fp = fopen(src, "r");' else '    memset(&rec, 0, sizeof(rec_t));' end
    when 4 then case l_suppkey % 8 when 0 then '    EXEC SQL SELECT a, b INTO :v1, :v2 FROM t WHERE id = :v' || (l_partkey % 5) || ';' when 1 then '    EXEC SQL INSERT INTO t (a, b) VALUES (:v1, :v2, :v3);'
        when 2 then '    EXEC SQL OPEN cur_' || (l_partkey % 3) || ';' when 3 then '    EXEC SQL CLOSE cur_' || (l_partkey % 3) || ';' when 4 then '    EXEC SQL DECLARE cur_' || (l_partkey % 3) || ' CURSOR FOR SELECT a FROM t;'
        when 5 then '    EXEC SQL UPDATE t SET a = :v1;' when 6 then '    EXEC SQL SELECT a, b, c INTO :v1 FROM t;' else '    fclose(fp);' end
    when 5 then case l_partkey % 4 when 0 then '    if (sqlca.sqlcode < 0) return -1;' when 1 then '    printf(fmt);' when 2 then '    buf[ idx ] = sqlca.sqlcode;' else '    printf("%d", cnt);' end
    when 6 then case (l_partkey + l_suppkey) % 12 when 0 then '    EXEC SQL COMMIT WORK;' when 1 then '    EXEC SQL ROLLBACK;' when 2 then '    EXEC SQL WHENEVER SQLERROR GOTO err;' when 3 then '    EXEC SQL WHENEVER SQLERROR CONTINUE;'
        when 4 then '    DBIO_CLOSE(cur_' || (l_partkey % 3) || ');' else '    cnt = cnt + 1;' end
    else '    fn_' || (ln % 7 + l_partkey % 2) || '(1, src);' end end as raw
from (select *, coalesce(sum(n) over (partition by l_orderkey order by ln rows between unbounded preceding and 1 preceding), 0) as before from (
    select *, 8 + l_partkey % 3 as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ln from lineitem) s) l {rows} where k <= n"""
PROC_SPARK = _PROC.format(rows="lateral view explode(sequence(1, 10)) e as k")
PROC_DUCK = "source_line as (" + _PROC.format(rows=", (select unnest(range(1, 11)) as k)") + ")"


def proc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_line(file_id, line_no, raw) from lineitem."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("sparkloupe_lineitem")
    return spark.sql(PROC_SPARK.replace("from lineitem", "from sparkloupe_lineitem")).drop("ln")
