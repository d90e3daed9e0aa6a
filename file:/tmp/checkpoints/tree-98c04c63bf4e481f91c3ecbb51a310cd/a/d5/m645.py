x645