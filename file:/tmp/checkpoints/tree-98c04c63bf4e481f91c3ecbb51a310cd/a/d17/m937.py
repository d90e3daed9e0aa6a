x937