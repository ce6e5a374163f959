"""Figures of backtest runs, and studies over many of them."""
