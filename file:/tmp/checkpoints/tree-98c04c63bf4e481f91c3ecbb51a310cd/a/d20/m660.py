x660