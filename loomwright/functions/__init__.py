"""Part of loomwright; see README.md."""
