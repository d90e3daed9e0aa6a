x893