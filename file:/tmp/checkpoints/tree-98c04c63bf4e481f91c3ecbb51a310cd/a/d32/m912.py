x912