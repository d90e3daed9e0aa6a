x268