"""Small hand-written inputs in the shapes of FIXTURES.md (our own content)."""

LOOP_SUM = """public class Main {
    public static void main(String[] args) {
        int total = 0;
        for (int i = 0; i < 10; i++) {
            total = total + i;   // accumulate
        }
        System.out.println("sum: " + total);
    }
}
"""

# identifiers renamed, comment changed, literal unchanged in kind
LOOP_SUM_RENAMED = """public class Main {
    public static void main(String[] args) {
        /* running value */
        int acc = 0;
        for (int k = 0; k < 10; k++) {
            acc = acc + k;
        }
        System.out.println("total: " + acc);
    }
}
"""

# two noise statements inside the loop body
LOOP_SUM_NOISE = """public class Main {
    public static void main(String[] args) {
        int total = 0;
        for (int i = 0; i < 10; i++) {
            int unused = 3;
            total = total + i;
            unused = unused * 2;
        }
        System.out.println("sum: " + total);
    }
}
"""

# body wrapped in an extra block
LOOP_SUM_WRAPPED = """public class Main {
    public static void main(String[] args) {
        {
            int total = 0;
            for (int i = 0; i < 10; i++) {
                total = total + i;
            }
            System.out.println("sum: " + total);
        }
    }
}
"""

CYLINDER = """import java.util.Scanner;
public class Cylinder {
    public static void main(String[] args) {
        Scanner in = new Scanner(System.in);
        double r = in.nextDouble();
        double h = in.nextDouble();
        double area = 2 * Math.PI * r * (r + h);
        double volume = Math.PI * r * r * h;
        System.out.println(area + " " + volume);
    }
}
"""
