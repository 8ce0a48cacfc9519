"""Compositions of operators: calibrated escalation, reply systems, benchmark."""
