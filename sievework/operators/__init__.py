"""sievework.operators"""
