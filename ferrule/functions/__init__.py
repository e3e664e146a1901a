"""Part of ferrule."""
