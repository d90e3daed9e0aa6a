x463