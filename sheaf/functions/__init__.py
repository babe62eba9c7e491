"""Column functions: text cleaning, INR formatting, emoji stripping, keyword classes, scalar helpers."""
