"""Column expressions (JVM side): P1-P3, P8-P13 building blocks and the 13a BLEU tokens."""
