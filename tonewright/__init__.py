"""Spark jobs for sung and spoken audio tables: pitch frames, notes, clips, catalogues and vectors."""
