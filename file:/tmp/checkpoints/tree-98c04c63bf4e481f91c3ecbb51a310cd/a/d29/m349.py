x349