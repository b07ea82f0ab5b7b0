"""Part of loxis; see the README."""
