x712