x327