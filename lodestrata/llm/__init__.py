"""Corpus operators for training data: one module per operator, their queries in ``queries``.

What holds for all of them, beside what each module says of nulls, empty and very long texts, ties and repeated rows:
an empty table gives an empty result; further columns, whatever their names, are left alone (operators that
return documents keep them); texts are read whole, and ties are broken by ids, so that a result doesn't depend
on how rows are dealt to tasks (sequence numbers of the packing, which name the task's own bins, aside).
"""
