x982