x315