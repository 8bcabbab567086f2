"""FN7 and FN8 over whole texts, as Java that Spark's own compiler (Janino) builds.

Two texts cost the product of their lengths, so the distance is the work of a query over whole
texts.  Python's long integers need several times as long for a cell of it as the JVM's words, most of all
where texts are short and each step is one of the interpreter's.  The source below is compiled once per application, put as a jar into the checkpoint folder
(shared on a cluster) and added to the application; its functions are used as Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

# Rows of 64 cells as in Myers (1999) with Hyyro's carried differences, two rows at a time and the lower
# one a column behind, so that neither waits for the other.  Horizontal differences between passes
# are two bits in a byte, "not +1" and "-1"; u holds the complement of the +1 bits.
#
# A pass leaves out columns that no best alignment can cross: with a known bound on the distance (that of an
# alignment part by part) a column stays only if its value and the lengths still to be aligned do not exceed it.
# Left of what a pass covers the values grow by 1 a row, right of it by 1 a column, which is never too little;
# the columns that a best alignment crosses have their exact values, and so has the last one.
DISTANCE = """
package dupstream;

public class EditDistance implements org.apache.spark.sql.api.java.UDF2 {
    private static final long serialVersionUID = 1L;
    private static final int ROWS = 128;

    public Object call(Object a, Object b) {
        if (a == null || b == null) return null;
        return Integer.valueOf(distance((byte[]) a, (byte[]) b));
    }

    public org.apache.spark.sql.expressions.UserDefinedFunction function() {
        return org.apache.spark.sql.functions.udf((org.apache.spark.sql.api.java.UDF2) this,
            org.apache.spark.sql.types.DataTypes.IntegerType).withName("edit_distance");
    }

    public static int distance(byte[] a, byte[] b) {
        if (a.length > b.length) { byte[] other = a; a = b; b = other; }
        int from = 0, m = a.length, n = b.length;
        while (from < m && a[from] == b[from]) from++;             // equal ends cost nothing
        while (m > from && a[m - 1] == b[n - 1]) { m--; n--; }
        m -= from;
        n -= from;
        long[] at = new long[512];
        byte[] h = new byte[n];
        int most = n;
        if (m > 4 * ROWS) {                                        // an alignment by parts is a bound
            int parts = (m + ROWS - 1) / ROWS, cost = 0;
            for (int k = 0; k < parts; k++) {
                int i = (int) ((long) m * k / parts), j = (int) ((long) n * k / parts);
                int l = (int) ((long) m * (k + 1) / parts) - i, w = (int) ((long) n * (k + 1) / parts) - j;
                cost += within(a, from + i, l, b, from + j, w, Math.max(l, w), at, h);
            }
            most = Math.min(most, cost);
        }
        return within(a, from, m, b, from, n, most, at, h);
    }

    private static int within(byte[] a, int a0, int m, byte[] b, int b0, int n, int most, long[] e, byte[] h) {
        int lo = 0, hi = 0, end = 0, left = 0, last = 0;           // last: distance at hi
        for (int r = 0; r < m; r += ROWS) {
            if (lo == n) return left + m - r;
            int to = Math.min(n, (most + n - m + r + 2 * ROWS + hi - last) / 2);
            if (to > end) java.util.Arrays.fill(h, end, to, (byte) 0);
            int right = last;
            for (int j = hi; j < to; j++) right += 1 - (h[j] & 1) - (h[j] >> 1);
            end = to;
            int k = Math.min(64, m - r), l = Math.max(0, Math.min(64, m - r - 64));
            for (int i = 0; i < k; i++) e[a[a0 + r + i] & 255] |= 1L << i;
            for (int i = 0; i < l; i++) e[(a[a0 + r + 64 + i] & 255) + 256] |= 1L << i;
            long p = -1L, q = 0L, s = -1L, t = 0L;                 // vertical +1 and -1 of either row
            int c = b[b0 + lo] & 255;
            long g = h[lo], gn = g >>> 1;
            long x = e[c], v = x | q;
            x |= gn;
            long y = (((x & p) + p) ^ p) | x;
            long u = ~q & (y | p);
            y &= p;
            long cu = u >>> 63, cy = y >>> 63;
            u = (u << 1) | (g & 1L);
            y = (y << 1) | gn;
            p = y | (~v & u);
            q = ~u & v;
            for (int j = lo + 1; j < to; j++) {
                x = e[c + 256];
                v = x | t;
                x |= cy;
                y = (((x & s) + s) ^ s) | x;
                u = ~t & (y | s);
                y &= s;
                h[j - 1] = (byte) ((u >>> 63) | ((y >>> 62) & 2L));
                u = (u << 1) | cu;
                y = (y << 1) | cy;
                s = y | (~v & u);
                t = ~u & v;
                c = b[b0 + j] & 255;
                g = h[j];
                gn = g >>> 1;
                x = e[c];
                v = x | q;
                x |= gn;
                y = (((x & p) + p) ^ p) | x;
                u = ~q & (y | p);
                y &= p;
                cu = u >>> 63;
                cy = y >>> 63;
                u = (u << 1) | (g & 1L);
                y = (y << 1) | gn;
                p = y | (~v & u);
                q = ~u & v;
            }
            x = e[c + 256];
            v = x | t;
            x |= cy;
            y = (((x & s) + s) ^ s) | x;
            u = ~t & (y | s);
            y &= s;
            h[to - 1] = (byte) ((u >>> 63) | ((y >>> 62) & 2L));
            u = (u << 1) | cu;
            y = (y << 1) | cy;
            s = y | (~v & u);
            t = ~u & v;
            for (int i = 0; i < k; i++) e[a[a0 + r + i] & 255] = 0L;
            for (int i = 0; i < l; i++) e[(a[a0 + r + 64 + i] & 255) + 256] = 0L;
            long inK = k == 64 ? -1L : (1L << k) - 1L, inL = l == 64 ? -1L : (1L << l) - 1L;
            last = right + Long.bitCount(p & inK) - Long.bitCount(q & inK) + Long.bitCount(s & inL) - Long.bitCount(t & inL);
            if (m - r <= ROWS) return last;
            int rest = n - m + r + ROWS;                           // length left of b less that of a, plus the column
            left += ROWS;
            while (left + Math.abs(rest - lo) > most) { left += 1 - (h[lo] & 1) - (h[lo] >> 1); lo++; }
            hi = to;
            while (last + Math.abs(rest - hi) > most) { hi--; last -= 1 - (h[hi] & 1) - (h[hi] >> 1); }
        }
        return n;
    }
}
"""

MISMATCH = """
package dupstream;

public class PositionalMismatch implements org.apache.spark.sql.api.java.UDF2 {
    private static final long serialVersionUID = 1L;

    public Object call(Object a, Object b) {
        if (a == null || b == null) return null;
        byte[] x = (byte[]) a, y = (byte[]) b;
        int n = Math.min(x.length, y.length), differ = 0;
        for (int i = 0; i < n; i++) if (x[i] != y[i]) differ++;
        return Integer.valueOf(differ);
    }

    public org.apache.spark.sql.expressions.UserDefinedFunction function() {
        return org.apache.spark.sql.functions.udf((org.apache.spark.sql.api.java.UDF2) this,
            org.apache.spark.sql.types.DataTypes.IntegerType).withName("positional_mismatch");
    }
}
"""

CLASSES = {"edit_distance": ("dupstream.EditDistance", DISTANCE),
           "positional_mismatch": ("dupstream.PositionalMismatch", MISMATCH)}
_COMPILED: dict[str, dict] = {}    # application -> name -> function


def _functions(spark: SparkSession) -> dict:
    """The compiled functions of this application, built and shipped at first use."""
    from dupstream.session import ship_jar
    sc = spark.sparkContext
    if sc.applicationId not in _COMPILED:
        jvm, built, files = sc._jvm, {}, {}
        for name, (cls, source) in CLASSES.items():
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(source)
            files |= {f"{c.replace('.', '/')}.class": bytes(b) for c, b in compiler.getBytecodes().items()}
            made = compiler.getClassLoader().loadClass(cls).getDeclaredConstructor(sc._gateway.new_array(jvm.java.lang.Class, 0))
            built[name] = made.newInstance(sc._gateway.new_array(jvm.java.lang.Object, 0)).function()
        ship_jar(spark, files)
        _COMPILED[sc.applicationId] = built
    return _COMPILED[sc.applicationId]


def _applied(name: str, a, b) -> Column:
    from pyspark.sql.classic.column import Column as JavaColumn, _to_java_column, _to_seq
    spark = SparkSession.active()
    return JavaColumn(_functions(spark)[name].apply(_to_seq(spark.sparkContext, [a, b], _to_java_column)))


def byte_distance(a, b) -> Column:
    """FN8 between two BINARY texts: Levenshtein distance in bytes, NULL where a side is."""
    return _applied("edit_distance", a, b)


def byte_mismatch(a, b) -> Column:
    """FN7 between two BINARY texts: positions (up to the shorter length) with other bytes."""
    return _applied("positional_mismatch", a, b)
