x806