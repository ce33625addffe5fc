"""Text evidence at corpus scale, as DataFrame expressions."""
