"""DataFrame -> DataFrame operators: T1-T4/W1-W2 (select), dense numbering and prefix sums,
A2-A6/A13 (bleu), A1/J2/J3/P4-P6 (vocab), P1-P3/P7-P13 (text_jobs), M1-M3/A8 (assembly),
A7/A9-A12 (runs), U1-U3 (udf)."""
